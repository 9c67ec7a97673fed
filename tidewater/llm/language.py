"""Language identification with interpolated Kneser-Ney character models.

Every language has a model of the letters of its words: the probability of a letter given up to four before it (from the
blank before its word on), interpolated down to single letters and an even share of ``ALPHABET`` letters. Continuation counts
replace raw counts below the highest order, but for histories that begin with the blank, which nothing can precede. The
discounted shares and the back-off weights of all languages are stored in one sorted array of 64-bit hashes.

A text gets the language with the lowest cross-entropy in bits a letter; ties go to the smaller name. The score is the
softmax of the negative cross-entropies, with a factor fitted on calibration texts; a text is ``rejected`` if its cross-entropy
is far above what calibration texts of that language have, with more room for shorter texts.

The models are fitted on a bounded sample: ``SAMPLE`` documents per language (by a hash of the id), of which every fifth only
calibrates, and the ``WORDS`` most frequent words of the others. Every document is predicted over its whole text, in bounded
slices, each distinct word of a slice scored once.

Words are maximal runs of ASCII letters and non-ASCII characters, lower-cased. Nulls and edge cases: a null text or one
without a letter is ``und`` with score 0; rows with a null language or text are not learned from; without any such row all
texts are ``und``; a language without calibration texts uses the common limit; repeated rows are predicted each; further
columns stay as they are, but those named like an output are replaced; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import settled
from tidewater.llm.wordbytes import ALPHABETIC, Words
from tidewater.llm.words import mix, slices

ORDER, ALPHABET = 5, 4096
#: Documents of a language that its model is fitted and calibrated on, and words that it keeps, at most.
SAMPLE, WORDS = 1500, 50_000
#: Longer words are learned from in pieces of so many letters.
PIECE = 64
#: Standard deviations above the mean cross-entropy at which a long text is rejected.
REJECT = 4.0
UNKNOWN = "und"
#: Bytes of text whose words are scored at a time; letters scored at a time.
SLICE, BLOCK = 1 << 22, 1 << 16
_U, _EDGE = np.uint64, 10
_POWER = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(ORDER + 1)]


class Letters:
    """Letters of distinct words one after the other, each word between two edges it shares with its neighbours."""

    def __init__(self, words: list[str]):
        flat = "\n" + "\n".join(words) + "\n" if words else "\n"
        self.code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        edge = np.flatnonzero(self.code == _EDGE)
        self.first = edge[:-1] + 1  # of every word; its last predicted letter is the edge after it
        self.size = np.diff(edge)  # letters to predict
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.reach = np.arange(1, len(self.code)) - np.repeat(edge[:-1], self.size)  # letters of history, the edge included

    def hashes(self, a: int, b: int):
        """For each order the (valid positions, gram hash, history hash) of predicted letters a to b - 1."""
        at = np.arange(a, b) + 1
        gram, past = np.zeros(b - a, _U), np.zeros(b - a, _U)
        reach = self.reach[a:b]
        some = np.arange(b - a)
        for k in range(1, ORDER + 1):
            some = some[reach[some] >= k - 1]
            before, power = at[some] - (k - 1), _POWER[k]
            gram[some] += self.code[before] * power
            if k > 1:
                past[some] += self.code[before] * power
            yield k, some, mix(gram[some] + _U(2 * k)), mix(past[some] + _U(2 * k + 1))


def fit_language(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, values): discounted shares of grams and back-off weights of histories."""
    pieces = [(w[i:i + PIECE], n) for w, n in zip(words, counts) for i in range(0, len(w), PIECE)]
    letters = Letters([w for w, _ in pieces])
    times = np.array([n for _, n in pieces], np.float64)[letters.word]
    levels = {k: (some, gram, past) for k, some, gram, past in letters.hashes(0, len(times))}
    keys, values = [], []
    for k, (some, gram, past) in levels.items():
        grams, at, inverse = np.unique(gram, return_index=True, return_inverse=True)
        count = np.bincount(inverse, times[some], len(grams))
        if k < ORDER:
            longer, wide, _ = levels[k + 1]
            _, one = np.unique(wide, return_index=True)  # one place of every longer gram
            place = np.full(len(times), -1)
            place[some] = inverse
            distinct = np.bincount(place[longer[one]], minlength=len(grams))
            count = np.where(distinct > 0, distinct, count)  # grams that begin a word have nothing before them
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
        pasts, owner = np.unique(past[at], return_inverse=True)
        total, kinds = np.bincount(owner, count), np.bincount(owner)
        keys += [grams, pasts]
        values += [np.maximum(count - discount, 0) / total[owner], discount * kinds / total]
    keys, values = np.concatenate(keys), np.concatenate(values).astype(np.float32)
    order = np.argsort(keys)
    return keys[order], values[order]


@dataclass
class Model:
    """All languages in one sorted array: hash i has the entries start[i] to start[i + 1] - 1 of (lang, value)."""

    names: list[str]
    keys: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    value: np.ndarray
    factor: float = 20.0
    mean: dict[str | None, float] = field(default_factory=dict)
    spread: dict[str | None, float] = field(default_factory=dict)

    @staticmethod
    def of(parts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        names = sorted(parts)
        keys = np.concatenate([parts[n][0] for n in names])
        lang = np.repeat(np.arange(len(names), dtype=np.int32), [len(parts[n][0]) for n in names])
        value = np.concatenate([parts[n][1] for n in names])
        order = np.lexsort((lang, keys))
        keys, lang, value = keys[order], lang[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return Model(names, keys[first], np.append(first, len(keys)), lang, value)

    def look_up(self, hashes: np.ndarray, otherwise: float) -> np.ndarray:
        """Values per hash and language; ``otherwise`` where a language has none."""
        out = np.full((len(hashes), len(self.names)), otherwise)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        row = np.flatnonzero(self.keys[at] == hashes)
        at = at[row]
        n = self.start[at + 1] - self.start[at]
        entry = np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[np.repeat(row, n), self.lang[entry]] = self.value[entry]
        return out

    def bits(self, letters: Letters) -> np.ndarray:
        """Bits of every word under every language."""
        out = np.zeros((len(letters.size), len(self.names)))
        ends = np.cumsum(letters.size)
        w = a = 0
        while w < len(ends):
            v = max(int(np.searchsorted(ends, a + BLOCK, "right")), w + 1)  # whole words, or one long word in blocks
            while a < ends[v - 1]:
                b = min(a + BLOCK, int(ends[v - 1]))
                p = np.full((b - a, len(self.names)), 1.0 / ALPHABET)
                for _, some, gram, past in letters.hashes(a, b):
                    p[some] = self.look_up(gram, 0.0) + self.look_up(past, 1.0) * p[some]
                word = letters.word[a:b] - w
                for k in range(len(self.names)):
                    out[w:v, k] -= np.bincount(word, np.log2(p[:, k]), v - w)
                a = b
            w = v
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text (bits a letter under every language, letters, whether there is a letter at all)."""
        words = Words(column, ALPHABETIC)
        coded = words.strings().dictionary_encode()
        known = pc.utf8_lower(coded.dictionary).to_pylist()
        letters = Letters(known)
        code = coded.indices.to_numpy()
        plain = np.zeros(len(known), bool)
        np.logical_or.at(plain, letters.word, letters.code[1:] >= 97)  # cheap: ASCII letters; the edge is below
        for i in np.flatnonzero(np.bincount(letters.word, (letters.code[1:] < 128) & (letters.code[1:] >= 97), len(known)) == 0):
            plain[i] = any(c.isalpha() for c in known[i])
        bits, n = np.zeros((len(words), len(self.names))), np.zeros(len(words))
        has = np.zeros(len(words), bool)
        full = np.flatnonzero(np.diff(words.bounds))
        if len(full):
            first = words.bounds[:-1][full]
            bits[full] = np.add.reduceat(self.bits(letters)[code], first)
            n[full] = np.add.reduceat(letters.size[code], first)
            has[full] = np.logical_or.reduceat(plain[code], first)
        return bits / np.maximum(n, 1)[:, None], n.astype(np.int64), has

    def chances(self, entropy: np.ndarray) -> np.ndarray:
        z = -self.factor * (entropy - entropy.min(1, keepdims=True))
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    def limit(self, lang: str, letters: int) -> float:
        mean, spread = (d.get(lang, d.get(None, 0.0)) for d in (self.mean, self.spread))
        return mean + REJECT * spread * (1 + 256 / max(letters, 1)) ** 0.5


def _sample(docs: DataFrame, lang_col: str, id_col: str, text_col: str, held_out, most: int) -> DataFrame:
    """(lang, text, check) of at most ``most`` learnable documents per language (rows of equal id count as one)."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("lang is not null")
    if held_out is not None:
        rows = rows.filter(~held_out(F.col("id")))
    rows = rows.withColumn("h", F.xxhash64("id"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = settled(rows.select("lang", "h").withColumn("place", place).filter(F.col("place") <= most).groupBy("lang").agg(F.max("h").alias("last")), "last")
    return settled(rows.join(last, "lang").filter("h <= last and text is not null").select("lang", "text", (F.pmod(F.xxhash64("h"), F.lit(5)) == 0).alias("check")), "texts")


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text) rows, counted per slice before the shuffle."""

    def run(batches):
        for whole in batches:
            for i, j in slices(whole.column(1), SLICE):
                part = whole.slice(i, j - i)
                words = Words(part.column(1), ALPHABETIC)
                t = pa.table([part.column(0).take(pa.array(np.repeat(np.arange(len(words)), np.diff(words.bounds)))), pc.utf8_lower(words.strings()).cast(pa.string())], names=["lang", "word"])
                yield from t.group_by(["lang", "word"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["lang", "word", "n"]).to_batches()

    return texts.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", held_out=None, most: int = SAMPLE, words: int = WORDS) -> Model | None:
    """Fitted and calibrated models of all languages, or None where there is nothing to learn from."""
    texts = _sample(docs, lang_col, id_col, text_col, held_out, most)
    counted = word_counts(texts.filter("not check"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))

    def fit(key, rows):
        rows = rows.sort_by("word")
        keys, values = fit_language(rows["word"].to_pylist(), rows["n"].to_numpy())
        return pa.table([pa.array([key[0].as_py()]), pa.array([keys.tobytes()]), pa.array([values.tobytes()])], names=["lang", "keys", "values"])

    kept = counted.withColumn("place", place).filter(F.col("place") <= words).select("lang", "word", "n")
    fitted = kept.groupBy("lang").applyInArrow(fit, "lang string, keys binary, values binary").toArrow().to_pylist()  # bounded by WORDS per language
    if not fitted:
        return None
    model = Model.of({r["lang"]: (np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["values"], np.float32)) for r in fitted})
    calibrate(model, texts.filter("check"))
    return model


def calibrate(model: Model, texts: DataFrame) -> None:
    """Fits the factor of the score by likelihood, and mean and spread of the cross-entropy per language."""
    rows = _scored(texts.select("lang", "text"), model, "text").filter("has").select("lang", "entropy").toArrow()  # bounded by SAMPLE per language
    if not len(rows):
        return
    truth, entropy = np.array(rows["lang"].to_pylist()), np.array(rows["entropy"].to_pylist())
    at = np.searchsorted(model.names, truth)
    ok = (at < len(model.names)) & (np.array(model.names)[np.minimum(at, len(model.names) - 1)] == truth)
    truth, entropy, at = truth[ok], entropy[ok], at[ok]
    if not len(at):
        return
    best = -np.inf
    for factor in 2.0 ** np.arange(-2, 7):
        z = -factor * (entropy - entropy.min(1, keepdims=True))
        chance = np.exp(z[np.arange(len(at)), at]) / np.exp(z).sum(1)
        fit = np.log(0.98 * chance + 0.02 / len(model.names)).sum()  # some labels are wrong
        if fit > best + 1e-9:
            best, model.factor = fit, float(factor)
    own = entropy[np.arange(len(at)), at]
    for name in [None, *np.unique(truth).tolist()]:
        some = own if name is None else own[truth == name]
        middle = float(np.median(some))
        model.mean[name], model.spread[name] = middle, max(1.4826 * float(np.median(np.abs(some - middle))), 0.02)


def _scored(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``docs`` with entropy array<double>, letters long and has boolean."""
    keep = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("entropy", T.ArrayType(T.DoubleType())), T.StructField("letters", T.LongType()), T.StructField("has", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS per language

    def run(batches):
        model = shared.value
        for whole in batches:
            for i, j in slices(whole.column(text_col), SLICE):
                part = whole.slice(i, j - i)
                entropy, n, has = model.entropies(part.column(text_col))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * len(model.names), pa.int32()), pa.array(entropy.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists, pa.array(n), pa.array(has)], names=[*keep, "entropy", "letters", "has"])

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep_text: bool = True, reject: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy (bits a letter) and rejected; with ``reject`` a rejected text is ``und``."""
    made = ["lang_pred", "score", "cross_entropy", "rejected"]
    keep = [c for c in docs.columns if c not in made]
    back = [c for c in keep if keep_text or c != text_col]
    if model is None:
        return docs.select(*back, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("rejected"))
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*(docs.schema[c] for c in back), *(T.StructField(c, t) for c, t in zip(made, kinds))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS per language

    def run(batches):
        model = shared.value
        for whole in batches:
            for i, j in slices(whole.column(len(keep)), SLICE):
                part = whole.slice(i, j - i)
                entropy, n, has = model.entropies(part.column(len(keep)))
                best = entropy.argmin(1)
                least = entropy[np.arange(len(best)), best]
                far = np.array([h and e > model.limit(model.names[b], k) for h, e, b, k in zip(has, least, best, n)], bool)
                score = np.where(has, model.chances(entropy)[np.arange(len(best)), best], 0.0)
                names = [model.names[b] if h and not (reject and f) else UNKNOWN for b, h, f in zip(best, has, far)]
                yield pa.RecordBatch.from_arrays([*(part.column(keep.index(c)) for c in back), pa.array(names), pa.array(score),
                                                  pa.array(least, pa.float64(), mask=~has), pa.array(far)], names=[*back, *made])

    text = F.col(text_col).cast("string").alias("__text")
    return docs.select(*keep, text).mapInArrow(run, schema)
