"""Masked pseudo-likelihood: a bidirectional window network in numpy predicts every token from both sides.

The two words before and the two after a token (never the token itself) are embedded, projected and squashed; a
two-level softmax (class, word within the class) gives the token's probability. A document's score is the sum of its
tokens' log probabilities. The network tells apart the most frequent words of the whole corpus and hashed buckets of
all others; a word of a bucket then gets its share of it by the counts of all words, whose table grows with the corpus
and stays distributed: log P(bucket) + log((count + 1) / (tokens + words + 1)), where a word never seen counts 0.
Frequent ones are looked up in a broadcast of bounded size, the others by a shuffled join. Training goes once over every token of every document: in each round all tasks train from the same weights on
their part, and the weights are averaged by token counts with a shuffled sum, so nothing but the averaged network
(a fixed 0.2 MB) reaches the driver.

Nulls and edge cases: a null or empty text has 0 tokens, score 0 and a null mean; a text of one word is predicted from
padding; an empty corpus gives the untrained network; repeated rows are trained on and scored each; further columns
stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import settled
from tidewater.llm.words import LETTERS, Batch, slices

KNOWN, BUCKETS = 768, 256
VOCABULARY = KNOWN + BUCKETS
DIMS, HIDDEN, CLASSES, PER_CLASS = 16, 32, 32, 32
REACH = 2
OFFSETS = (-2, -1, 1, 2)
STEP, ROUNDS = 8192, 2
#: Words of the buckets whose counts every task gets (1 MB); all others are joined.
LOCAL = 65_536


@dataclass
class Window:
    words: np.ndarray  # sorted hashes of the known words
    ids: np.ndarray  # their ids
    params: list[np.ndarray]  # embedding, input, input bias, class, class bias, word, word bias

    @staticmethod
    def fresh(words: np.ndarray, seed: int = 3) -> Window:
        r = np.random.default_rng(seed)
        order = np.argsort(words)
        normal = lambda scale, *shape: r.normal(0, scale, shape).astype(np.float32)
        params = [normal(0.1, VOCABULARY + 1, DIMS), normal(0.15, len(OFFSETS) * DIMS, HIDDEN), np.zeros(HIDDEN, np.float32),
                  normal(0.1, HIDDEN, CLASSES), np.zeros(CLASSES, np.float32), normal(0.1, CLASSES, HIDDEN, PER_CLASS), np.zeros((CLASSES, PER_CLASS), np.float32)]
        return Window(words[order], order.astype(np.int64), params)

    def tokens(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """(ids with padding between texts, place of every token among them)."""
        h, n = batch.hash, len(batch)
        ids = KNOWN + (h >> np.uint64(33)).astype(np.int64) % BUCKETS
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            ids = np.where(self.words[at] == h, self.ids[at], ids)
        place = np.arange(len(h)) + REACH * (1 + np.repeat(np.arange(n), np.diff(batch.bounds)))
        padded = np.full(len(h) + REACH * (n + 1), VOCABULARY, np.int64)
        padded[place] = ids
        return padded, place

    def hidden(self, padded: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        embed, w, b = self.params[:3]
        x = np.concatenate([embed[padded[place + o]] for o in OFFSETS], axis=1)
        return x, np.tanh(x @ w + b)

    def log_probs(self, padded: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.empty(len(place))
        for i in range(0, len(place), STEP):
            here = place[i:i + STEP]
            _, h = self.hidden(padded, here)
            target = padded[here]
            kind, inside = target // PER_CLASS, target % PER_CLASS
            _, wc, bc, ww, bw = self.params[2:]
            z = h @ wc + bc
            got = z[np.arange(len(here)), kind] - _log_sum(z)
            order = np.argsort(kind, kind="stable")
            edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
            for c in range(CLASSES):
                rows = order[edges[c]:edges[c + 1]]
                if len(rows):
                    y = h[rows] @ ww[c] + bw[c]
                    got[rows] += y[np.arange(len(rows)), inside[rows]] - _log_sum(y)
            out[i:i + STEP] = got
        return out

    def train(self, padded: np.ndarray, place: np.ndarray, past: list[np.ndarray], rate: float = 0.1) -> None:
        """One Adagrad step per ``STEP`` tokens."""
        for i in range(0, len(place), STEP):
            here = place[i:i + STEP]
            n = len(here)
            x, h = self.hidden(padded, here)
            target = padded[here]
            kind, inside = target // PER_CLASS, target % PER_CLASS
            embed, w, b, wc, bc, ww, bw = self.params
            p = _softmax(h @ wc + bc)
            p[np.arange(n), kind] -= 1
            p /= n
            g_h, g_wc, g_bc = p @ wc.T, h.T @ p, p.sum(0)
            g_ww, g_bw = np.zeros_like(ww), np.zeros_like(bw)
            order = np.argsort(kind, kind="stable")
            edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
            for c in range(CLASSES):
                rows = order[edges[c]:edges[c + 1]]
                if len(rows):
                    q = _softmax(h[rows] @ ww[c] + bw[c])
                    q[np.arange(len(rows)), inside[rows]] -= 1
                    q /= n
                    g_h[rows] += q @ ww[c].T
                    g_ww[c], g_bw[c] = h[rows].T @ q, q.sum(0)
            g_h *= 1 - h * h
            g_w, g_b = x.T @ g_h, g_h.sum(0)
            g_x = (g_h @ w.T).reshape(n, len(OFFSETS), DIMS)
            read = np.stack([padded[here + o] for o in OFFSETS], axis=1).ravel()
            order = np.argsort(read, kind="stable")
            rows, first = np.unique(read[order], return_index=True)
            g_e = np.add.reduceat(g_x.reshape(-1, DIMS)[order], first, axis=0)
            past[0][rows] += g_e ** 2
            embed[rows] -= rate * g_e / np.sqrt(past[0][rows])
            for p_, old, g in zip((w, b, wc, bc, ww, bw), past[1:], (g_w, g_b, g_wc, g_bc, g_ww, g_bw)):
                old += g ** 2
                p_ -= rate * g / np.sqrt(old)


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(1)
    return top + np.log(np.exp(z - top[:, None]).sum(1))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): occurrences of every word hash over all texts."""

    def run(batches):
        for whole in batches:
            for i, j in slices(whole.column(0)):
                words, n = np.unique(Batch(whole.column(0).slice(i, j - i), LETTERS).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Shares:
    """What splits a bucket's probability among its words: log(count + 1) of the word less ``base`` of the bucket."""

    base: np.ndarray  # per bucket the log of all its tokens, distinct words and one word never seen
    words: np.ndarray  # sorted hashes of the frequent words of the buckets
    weights: np.ndarray  # their log(count + 1)

    def __call__(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log share of every token as far as known here, whether the word's weight is still to be added)."""
        rare = ids >= KNOWN
        found, weight = np.zeros(len(h), bool), np.zeros(len(h))
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            found = self.words[at] == h
            weight = np.where(found, self.weights[at], 0.0)
        return np.where(rare, weight - self.base[np.where(rare, ids - KNOWN, 0)], 0.0), rare & ~found


def shares(counts: DataFrame, net: Window, local: int = LOCAL) -> tuple[Shares, DataFrame]:
    """The part of the word counts that every task gets, at most ``local`` words, and the table (word, weight) of all others."""
    known = counts.sparkSession.createDataFrame([(int(w),) for w in net.words.view(np.int64)], "word long")
    level = F.floor(F.log2("n") * 4)
    rare = settled(counts.join(F.broadcast(known), "word", "left_anti").select("word", F.log(F.col("n") + 1).alias("weight"), "n", level.alias("level")), "rare-words")
    sums = rare.groupBy(F.shiftrightunsigned("word", 33) % BUCKETS).agg(F.sum("n"), F.count(F.lit(1))).collect()
    base = np.zeros(BUCKETS)
    for bucket, tokens, words in sums:
        base[bucket] = np.log(tokens + words + 1)
    least, total = math.inf, 0
    for at, n in sorted(rare.groupBy("level").count().collect(), reverse=True):
        total += n
        if total > local:
            break
        least = at
    frequent = rare.filter(F.col("level") >= float(least)).select("word", "weight").toArrow()
    words = frequent["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    return Shares(base, words[order], frequent["weight"].to_numpy()[order]), rare.filter(F.col("level") < float(least)).select("word", "weight")


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, seed: int = 3, counts: DataFrame | None = None) -> Window:
    top = (word_counts(docs, text_col) if counts is None else counts).orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    net = Window.fresh(np.array([r["word"] for r in top], np.int64).view(np.uint64), seed)
    text = F.col(text_col).cast("string")
    for round_ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(net)

        def run(batches, shared=shared):
            net = shared.value
            net = Window(net.words, net.ids, [p.copy() for p in net.params])
            past, seen = [np.full_like(p, 1e-4) for p in net.params], 0
            for whole in batches:
                for i, j in slices(whole.column(0)):
                    padded, place = net.tokens(Batch(whole.column(0).slice(i, j - i), LETTERS))
                    net.train(padded, place, past)
                    seen += len(place)
            if seen:
                flat = np.concatenate([p.ravel() for p in net.params]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))], names=["at", "sum", "weight"])

        part = docs.filter(F.pmod(F.xxhash64(text), F.lit(rounds)) == round_).select(text)
        sums = part.mapInArrow(run, "at long, sum double, weight double").groupBy("at").agg((F.sum("sum") / F.sum("weight")).alias("value"))
        made = sums.toArrow().sort_by("at")
        shared.unpersist()
        if made.num_rows:
            flat, params, k = made["value"].to_numpy().astype(np.float32), [], 0
            for p in net.params:
                params.append(flat[k:k + p.size].reshape(p.shape))
                k += p.size
            net = Window(net.words, net.ids, params)
    return net


def score(docs: DataFrame, net: Window, text_col: str = "text", counts: DataFrame | None = None, keep_text: bool = True, local: int = LOCAL) -> DataFrame:
    """``docs`` with n_tokens, log_prob (sum over all tokens) and mean_log_prob.

    ``counts`` are the ``word_counts`` of the corpus; without them words outside the vocabulary get their bucket's probability.
    """
    added = ["n_tokens", "log_prob", "mean_log_prob"]
    keep = [c for c in docs.columns if c not in added and (keep_text or c != text_col)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("__text_key", T.LongType()), T.StructField("__open", T.LongType())])
    split, table = (None, None) if counts is None else shares(counts, net, local)
    shared = docs.sparkSession.sparkContext.broadcast((net, split))
    docs = docs.withColumn("__text_key", F.xxhash64(F.col(text_col).cast("string")))

    def run(batches):
        net, split = shared.value
        for whole in batches:
            for i, j in slices(whole.column(text_col)):
                part = whole.slice(i, j - i)
                batch = Batch(part.column(text_col), LETTERS)
                padded, place = net.tokens(batch)
                logs, still = net.log_probs(padded, place), np.zeros(len(place), bool)
                if split is not None:
                    share, still = split(batch.hash, padded[place])
                    logs = logs + share
                per_row = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[batch.bounds])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(np.diff(batch.bounds).astype(np.int64)), pa.array(per_row(logs).astype(np.float64)), part.column("__text_key"), pa.array(per_row(still).astype(np.int64))],
                    names=[*keep, *added[:2], "__text_key", "__open"])

    def open_words(batches):
        net, split = shared.value
        for whole in batches:
            for i, j in slices(whole.column(0)):
                batch = Batch(whole.column(0).slice(i, j - i), LETTERS)
                padded, place = net.tokens(batch)
                still = split(batch.hash, padded[place])[1]
                row = np.repeat(np.arange(len(batch)), np.diff(batch.bounds))[still]
                yield pa.RecordBatch.from_arrays([whole.column(1).slice(i, j - i).take(pa.array(row)), pa.array(batch.hash[still].view(np.int64))], names=["key", "word"])

    scored = docs.mapInArrow(run, schema)
    if counts is not None:  # the mean over a text's words is the same however often the text is repeated
        open_ = docs.select(F.col(text_col).cast("string"), "__text_key").mapInArrow(open_words, "key long, word long").join(table, "word", "left")
        means = settled(open_.groupBy("key").agg(F.avg(F.coalesce("weight", F.lit(0.0))).alias("mean")), "rare-means")
        scored = scored.join(means, scored["__text_key"] == means["key"], "left").withColumn("log_prob", F.col("log_prob") + F.coalesce(F.col("__open") * F.col("mean"), F.lit(0.0)))
    return scored.select(*keep, *added[:2], F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))
