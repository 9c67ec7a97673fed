"""Toxicity: a small convolutional text classifier in numpy, with thresholds calibrated by language.

Every word is the sum of three hashed embeddings (the word and its first four and five bytes, so inflected forms share
evidence). Filters of width 1, 2 and 3 slide over the whole text, their largest responses feed a logistic output.
One embedding dimension starts from smoothed log odds of the labelled rows; everything is then trained by Adagrad.

Every labelled row that is not held out is used: four of five for the log odds and the training, one of five (by a hash of
the id) for the thresholds. Training goes in rounds: blocks of rows start from the same network side by side, and what they
change is averaged by the rows of the blocks that change it. Only sums per parameter and counts per threshold reach the driver, as many at every size.
All documents are scored over their whole text in bounded slices. Language only chooses the decision threshold.

Nulls and edge cases: a null or empty text gets the score of a text without words; ids without a label, or with a null
one, are only scored; conflicting labels of an id count as toxic; without labelled rows of both classes every score is
0; a language that is null or rare among the labelled rows uses the common threshold; repeated rows are scored each; further
columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import picked, settled
from tidewater.llm.words import LETTERS, Batch, slices

BUCKETS, DIMS, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 16
PREFIXES = (4, 5)
PAD = (1 + len(PREFIXES)) * BUCKETS
#: Rounds of training, and the labelled rows that one block trains on.
ROUNDS, BLOCK = 6, 2000
#: Thresholds to choose from.
GRID = np.linspace(0.5, 0.9, 41)


def features(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts): one row of embedding rows per word; every text ends with padding for the widest filter."""
    tail, n = max(WIDTHS), len(batch)
    counts = np.diff(batch.bounds)
    starts = batch.bounds[:-1] + tail * np.arange(n)
    ids = np.full((len(batch.hash) + tail * n, 1 + len(PREFIXES)), PAD, np.int32)
    where = np.arange(len(batch.hash)) + tail * np.repeat(np.arange(n), counts)
    for k, h in enumerate([batch.hash, *(batch.prefix[p] for p in PREFIXES)]):
        ids[where, k] = (h >> np.uint64(40)) % np.uint64(BUCKETS) + np.uint64(k * BUCKETS)
    return ids, starts


@dataclass
class Network:
    embed: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIMS, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        embed = np.zeros((PAD + 1, DIMS), np.float32)
        embed[:PAD, 1:] = r.normal(0, 0.05, (PAD, DIMS - 1))
        filters = [r.normal(0, 0.3 / w, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0, :] = np.abs(f[:, 0, :])
        return Network(embed, filters, np.zeros(n, np.float32), np.full(n, 0.1, np.float32), -2.0)

    def pooled(self, ids: np.ndarray, starts: np.ndarray, where: bool = False):
        """Largest response of every filter per text, and on request the place of it."""
        x = self.embed[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.embed[ids[:, k]]
        x = np.concatenate([x, np.zeros((max(WIDTHS) - 1, DIMS), np.float32)])
        tops, places, n = [], [], len(ids)
        ends = [*starts[1:], n]
        for f in self.filters:
            y = x[:n] @ f[0]
            for j in range(1, len(f)):
                y += x[j:n + j] @ f[j]
                y[np.asarray(ends) - j] = -np.inf  # a window stays within its text
            if where:
                at = np.array([a + y[a:b].argmax(0) for a, b in zip(starts, ends)]).reshape(len(starts), FILTERS)
                places.append(at)
                tops.append(y[at, np.arange(FILTERS)])
            else:
                tops.append(np.maximum.reduceat(y, starts, axis=0))
        top = np.concatenate(tops, axis=1) + self.bias
        return (top, places, x) if where else top

    def score(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        z = np.maximum(self.pooled(ids, starts), 0) @ self.out + self.shift
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def flat(self) -> np.ndarray:
        return np.concatenate([*(p.ravel() for p in (self.embed, *self.filters, self.bias, self.out)), [self.shift]]).astype(np.float64)

    def moved(self, flat: np.ndarray) -> Network:
        """The network with the parameters ``flat``."""
        made, k = [], 0
        for p in (self.embed, *self.filters, self.bias, self.out):
            made.append(flat[k:k + p.size].reshape(p.shape).astype(np.float32))
            k += p.size
        return Network(made[0], made[1:-2], made[-2], made[-1], float(flat[k]), dict(self.thresholds))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.thresholds.get(None, 0.7))


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(texts), np.cumsum([0, *(len(t) for t in texts[:-1])])


def fit(net: Network, texts: list[np.ndarray], labels: np.ndarray, rate: float, seed: int) -> Network:
    """``net`` after one pass over feature rows per text (each with its padding) in random order."""
    net = net.moved(net.flat())
    past = [np.full_like(p, 1e-6) for p in (net.embed, *net.filters, net.bias, net.out)]
    past_shift = 1e-6
    order = np.random.default_rng(seed).permutation(len(texts))
    for i in range(0, len(order), 32):
        some = order[i:i + 32]
        ids, starts = _joined([texts[j] for j in some])
        top, places, x = net.pooled(ids, starts, where=True)
        act = np.maximum(top, 0)
        z = act @ net.out + net.shift
        err = ((1 / (1 + np.exp(-z)) - labels[some]) / len(some)).astype(np.float32)
        g_top = np.outer(err, net.out) * (top > 0)
        grads = [act.T @ err, g_top.sum(0)]
        rows, deltas, g_filters = [], [], []
        for k, (f, at) in enumerate(zip(net.filters, places)):
            g = g_top[:, k * FILTERS:(k + 1) * FILTERS]
            gf = np.zeros_like(f)
            for j in range(len(f)):
                here = np.minimum(at + j, len(ids) - 1)
                gf[j] = np.einsum("bfd,bf->df", x[at + j], g)
                delta = g[:, :, None] * f[j].T[None]
                for c in range(ids.shape[1]):
                    rows.append(ids[here, c].ravel())
                    deltas.append(delta.reshape(-1, DIMS))
            g_filters.append(gf)
        rows_all = np.concatenate(rows)
        uniq, inverse = np.unique(rows_all, return_inverse=True)
        g_embed = np.zeros((len(uniq), DIMS), np.float32)
        np.add.at(g_embed, inverse, np.concatenate(deltas))
        g_embed[uniq == PAD] = 0
        past[0][uniq] += g_embed ** 2
        net.embed[uniq] -= rate * g_embed / np.sqrt(past[0][uniq])
        for p, h, g in zip([*net.filters, net.bias, net.out], past[1:], [*g_filters, grads[1], grads[0]]):
            h += g ** 2
            p -= rate * g / np.sqrt(h)
        past_shift += float(err.sum()) ** 2
        net.shift -= rate * float(err.sum()) / np.sqrt(past_shift)
    return net


def _texts(batches, column: int):
    """(rows, feature rows per text) of bounded slices of the batches."""
    for whole in batches:
        for i, j in slices(whole.column(column)):
            part = whole.slice(i, j - i)
            ids, starts = features(Batch(part.column(column), LETTERS, PREFIXES))
            yield part, [ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)])]


def _blocks(batches):
    """(block, texts, labels) of rows (block, label, text) sorted by block; very large blocks in pieces."""
    block, texts, labels = None, [], []
    for part, found in _texts(batches, 2):
        for b, label, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), found):
            if texts and (b != block or len(texts) >= 2 * BLOCK):
                yield block, texts, np.array(labels, np.float32)
                texts, labels = [], []
            block = b
            texts.append(t)
            labels.append(label)
    if texts:
        yield block, texts, np.array(labels, np.float32)


def labelled(docs: DataFrame, labels: DataFrame, held_out=None, block: int = BLOCK) -> DataFrame:
    """(check, block, label, lang, text) of every row with a label that is not held out; sorted by block within its files."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).filter("label in (0, 1)")
    if held_out is not None:
        known = known.filter(~held_out(F.col("doc_id")))
    known = settled(known.select(F.col("doc_id").alias("known_id"), "label"), "labels")
    blocks = max(1, -(-known.count() // block))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), lang.cast("string").alias("lang"))
    rows = texts.join(picked(known), F.col("doc_id") == F.col("known_id")).select(
        (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("check"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
        F.xxhash64("doc_id", "text").alias("place"), "label", "lang", "text")
    return settled(rows.repartition(blocks, "block").sortWithinPartitions("block", "place").drop("place"), "labelled")


def log_odds(rows: DataFrame, n: list[int]) -> np.ndarray:
    """Smoothed log odds of label 1 per feature over all ``rows`` (label, text), of which ``n`` have label 0 and 1."""

    def run(batches):
        for part, texts in _texts(batches, 1):
            seen = np.zeros((2, PAD + 1), np.int64)
            for t, label in zip(texts, part.column(0).to_pylist()):
                seen[label, np.unique(t)] += 1
            at = np.flatnonzero(seen.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["at", "clean", "toxic"])

    sums = rows.mapInArrow(run, "at int, clean long, toxic long").groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen = np.zeros((2, PAD + 1))
    if sums.num_rows:
        at = sums["at"].to_numpy()
        seen[0, at], seen[1, at] = sums["clean"].to_numpy(), sums["toxic"].to_numpy()
    n = [max(x, 1) for x in n]
    return np.log((seen[1] + 3 * n[1] / sum(n)) / n[1]) - np.log((seen[0] + 3 * n[0] / sum(n)) / n[0])


def calibrate(net: Network, rows: DataFrame, least: int = 40) -> None:
    """The threshold of the best F1 on all ``rows`` (label, lang, text), and per language, all within 0.5 to 0.9."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for part, texts in _texts(batches, 2):
            level = np.searchsorted(GRID, shared.value.score(*_joined(texts)), side="right")
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(level.astype(np.int32))], names=["label", "lang", "level"])

    counts: dict = {}
    for label, lang, level, n in rows.mapInArrow(run, "label int, lang string, level int").groupBy("label", "lang", "level").count().collect():
        for key in {None, lang}:
            counts.setdefault(key, np.zeros((2, len(GRID) + 1)))[label, level] += n
    for lang, n in counts.items():
        if lang is None or n.sum() >= least and n[1].any():
            hit = n[:, ::-1].cumsum(1)[:, ::-1][:, 1:]  # rows of each label that reach a threshold
            f1 = 2 * hit[1] / np.maximum(hit.sum(0) + n[1].sum(), 1e-9)
            tied = GRID[f1 >= f1.max() - 1e-9]
            net.thresholds[lang] = float(tied[np.argmin(np.abs(tied - 0.7))])


def train(docs: DataFrame, labels: DataFrame, held_out=None, rounds: int = ROUNDS, block: int = BLOCK, rate: float = 0.05, seed: int = 7) -> Network | None:
    """The fitted and calibrated network, or None without labelled rows of both classes."""
    rows = labelled(docs, labels, held_out, block)
    counts = {(r["check"], r["label"]): r["count"] for r in rows.groupBy("check", "label").count().collect()}
    if len({label for _, label in counts}) < 2:
        return None
    n = [counts.get((False, label), 0) for label in (0, 1)]
    learn, net = rows.filter("not check"), Network.fresh(seed)
    net.embed[:PAD, 0] = 0.3 * log_odds(learn.select("label", "text"), n)[:PAD]
    for round_ in range(rounds if sum(n) else 0):
        shared = docs.sparkSession.sparkContext.broadcast(net)

        def run(batches, shared=shared, round_=round_):
            first = shared.value.flat()
            total, weight = np.zeros_like(first), np.zeros_like(first)
            for which, texts, y in _blocks(batches):
                move = fit(shared.value, texts, y, rate / (1 + round_) ** 0.5, seed + 1000 * which + round_).flat() - first
                total += move * len(texts)
                weight[move != 0] += len(texts)
            at = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(weight[at])], names=["at", "move", "weight"])

        moves = learn.select("block", "label", "text").mapInArrow(run, "at int, move double, weight double")
        moves = moves.groupBy("at").agg((F.sum("move") / F.sum("weight")).alias("move")).toArrow()  # a word's parameters move as in the blocks that hold it
        flat = net.flat()
        flat[moves["at"].to_numpy()] += moves["move"].to_numpy()
        shared.unpersist()
        net = net.moved(flat)
    calibrate(net, rows.filter("check").select("label", "lang", "text"))
    return net


def score(docs: DataFrame, net: Network | None, text_col: str = "text", lang_col: str | None = "lang", to: str = "score", flag: str = "toxic") -> DataFrame:
    """``docs`` with the score of every whole text and whether it reaches the threshold of its language."""
    keep = [c for c in docs.columns if c not in (to, flag)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(to, T.DoubleType()), T.StructField(flag, T.BooleanType())])
    model = docs.sparkSession.sparkContext.broadcast(net)  # 3 MB whatever the input

    def run(batches):
        net = model.value
        for whole in batches:
            for i, j in slices(whole.column(text_col)):
                part = whole.slice(i, j - i)
                if net is None:
                    values = np.zeros(len(part))
                else:
                    values = net.score(*features(Batch(part.column(text_col), LETTERS, PREFIXES)))
                langs = part.column(lang_col).to_pylist() if lang_col in keep else [None] * len(part)
                flags = [net is not None and v >= net.threshold(x) for v, x in zip(values, langs)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(values, pa.float64()), pa.array(flags, pa.bool_())], names=[*keep, to, flag])

    return docs.mapInArrow(run, schema)
