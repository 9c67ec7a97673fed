"""Character models against a dictionary version of interpolated Kneser-Ney, and languages of held-out texts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import language


def plain_model(words, order=language.ORDER):
    """p(letter | history) by dictionaries; words: {word: count}."""
    grams = [Counter() for _ in range(order + 1)]
    for w, n in words.items():
        s = "\n" + w + "\n"
        for i in range(1, len(s)):
            for k in range(1, min(order, i + 1) + 1):
                grams[k][s[i - k + 1:i + 1]] += n
    counts = [None] * (order + 1)
    for k in range(1, order + 1):
        left = defaultdict(set)
        if k < order:
            for g in grams[k + 1]:
                left[g[1:]].add(g[0])
        counts[k] = {g: len(left[g]) or n for g, n in grams[k].items()}
    discount = [None]
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        discount.append(min(max(n[1] / max(n[1] + 2 * n[2], 1), 0.1), 0.95))
    total, kinds = [defaultdict(float) for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in counts[k].items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1

    def p(history, letter):
        out = 1 / language.ALPHABET
        for k in range(1, min(order, len(history) + 1) + 1):
            h = history[len(history) - k + 1:]
            if h in total[k]:
                out = max(counts[k].get(h + letter, 0) - discount[k], 0) / total[k][h] + discount[k] * kinds[k][h] / total[k][h] * out
        return out

    return p


def bits(p, word):
    s = "\n" + word + "\n"
    return -sum(math.log2(p(s[:i], s[i])) for i in range(1, len(s)))


def test_model_is_plain_kneser_ney():
    r = random.Random(2)
    vocab = {x: {"".join(r.choice(a) for _ in range(r.randrange(1, 9))): r.randrange(1, 6) for _ in range(150)} for x, a in (("aa", "abcdé"), ("bb", "acxyz"))}
    parts = {x: language.fit_language(list(v), np.array(list(v.values()))) for x, v in vocab.items()}
    model = language.Model.of(parts)
    asked = ["abc", "é", "zzzzzzzzzzzz", "xyzacd", "dca", "q", "aaaaé"]
    got = model.bits(language.Letters(asked))
    for k, x in enumerate(("aa", "bb")):
        p = plain_model(vocab[x])
        assert np.allclose(got[:, k], [bits(p, w) for w in asked], rtol=1e-4)
        h = "\nab"
        assert sum(p(h, c) for c in set("abcdéxyz\n")) <= 1 + 1e-9


def test_long_words_are_scored_in_blocks(monkeypatch):
    model = language.Model.of({"x": language.fit_language(["abab", "ba"], np.array([3, 1]))})
    words = ["ab", "abba" * 100, "b", "a" * 77]
    whole = model.bits(language.Letters(words))
    monkeypatch.setattr(language, "BLOCK", 7)
    assert np.allclose(model.bits(language.Letters(words)), whole)
    assert model.bits(language.Letters([])).shape == (0, 1)


SOUNDS = {"aa": ["ba", "na", "lo", "mi"], "bb": ["str", "eck", "und", "öh"], "cc": ["ción", "que", "los", "ña"]}


def say(r, lang, n):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randrange(1, 4))).capitalize() for _ in range(n))


def corpus(spark, n=450):
    r = random.Random(8)
    docs = [(i, lang, say(r, lang, r.randrange(1, 60)), 0.5) for i in range(n) for lang in [r.choice(list(SOUNDS))]]
    docs += [(n, "aa", None, 1.0), (n + 1, "aa", "", 1.0), (n + 2, None, "ba na lo", 1.0), (n + 3, "bb", "12 — 3.4", 1.0), (None, "cc", "que los", 1.0),
             (n + 4, None, say(r, "cc", 60_000), 1.0), (n + 5, None, "Zq" * 70_000, 1.0), docs[3], docs[3]]
    return spark.createDataFrame(docs, "doc_id long, lang string, text string, score double")


def test_held_out_languages(spark):
    docs = corpus(spark)
    held = lambda c: c % 4 == 2
    model = language.train(docs, held_out=held)
    out = language.predict(docs, model)
    assert out.columns == ["doc_id", "lang", "text", "lang_pred", "score", "cross_entropy", "rejected"]
    rows = out.collect()
    assert len(rows) == 459 and all(0 <= x.score <= 1 for x in rows)
    unseen = [x for x in rows if x.doc_id is not None and x.doc_id < 450 and x.doc_id % 4 == 2]
    assert sum(x.lang == x.lang_pred for x in unseen) >= 0.98 * len(unseen)
    by_id = {x.doc_id: x for x in rows}
    assert [by_id[i].lang_pred for i in (450, 451, 453)] == ["und"] * 3 and by_id[450].score == 0 and by_id[450].cross_entropy is None
    assert by_id[454].lang_pred == "cc" and by_id[452].lang_pred == "aa" and by_id[None].lang_pred == "cc"
    assert by_id[455].rejected and not by_id[454].rejected
    assert {x.lang_pred for x in language.predict(docs.filter("doc_id = 455"), model, reject=True).collect()} == {"und"}


def test_prediction_ignores_other_columns_and_partitions(spark):
    docs = corpus(spark)
    model = language.train(docs)
    a = {(x.doc_id, x.text): (x.lang_pred, x.score) for x in language.predict(docs.repartition(1), model).collect()}
    b = {(x.doc_id, x.text): (x.lang_pred, x.score) for x in language.predict(docs.repartition(6).selectExpr("doc_id", "text", "'x' as lang"), model).collect()}
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and math.isclose(a[k][1], b[k][1], rel_tol=1e-9) for k in a)


@pytest.mark.parametrize("lang", [None, "aa"])
def test_nothing_or_one_language(spark, lang):
    docs = spark.createDataFrame([(i, lang, "ba na lo") for i in range(12)], "doc_id string, lang string, text string")
    model = language.train(docs)
    found = {x.lang_pred for x in language.predict(docs, model).collect()}
    assert found == {lang or "und"}
    assert language.predict(docs.limit(0), model).count() == 0 and language.train(docs.limit(0)) is None


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "aa", "ba") for i in range(500)] + [(9, "bb", "eck")], "doc_id long, lang string, text string")
    rows = language._sample(docs, "lang", "doc_id", "text", None, 50).groupBy("lang").count().collect()
    assert {x["lang"]: x["count"] for x in rows} == {"aa": 50, "bb": 1}


def test_entropy_of_a_text():
    model = language.Model.of({"x": language.fit_language(["ab", "ba"], np.array([3, 1])), "y": language.fit_language(["cd"], np.array([2]))})
    entropy, n, has = model.entropies(pa.array(["Ab ba", None, "", "1 2", "—"]))
    words = model.bits(language.Letters(["ab", "ba"])).sum(0)
    assert np.allclose(entropy[0], words / 6) and n.tolist() == [6, 0, 0, 0, 2] and has.tolist() == [True, False, False, False, False]
