"""Source divergence against plain Python over dense tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import divergence


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, least=10, top=10):
    """Rows (lang, source, part, item, value, rank) for docs of (lang, source, text)."""
    used, seen, groups = defaultdict(Counter), Counter(), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        used[lang, source].update(terms_of(text))
        seen.update((lang, t) for t in set(terms_of(text)))
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in seen.items() if x == lang and n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: used[lang, s][t] for t in kept})

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(used[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if used[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, o, v, i + 1) for i, (o, v) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def corpus(n=600, seed=3):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        lang = r.choice(["en", "en", "de", None])
        source = "hot" if r.random() < 0.4 else r.choice([f"s{r.randrange(9)}", None, ""])
        words = [f"{r.choice('abcdefgh')}{r.choice('äßxyz')}{'q' * int(r.expovariate(1))}" for _ in range(r.randrange(0, 40))]
        docs.append((lang, source, " 7-".join(w.upper() if r.random() < 0.3 else w for w in words)))
    docs += [("en", "only-null", None), ("en", "blank", ""), ("xx", "alone", "a b c"), ("yy", "one", "rare"), ("yy", "two", "words"), ("en", "hot", "ax " * 40_000)]
    return docs + docs[:40]


@pytest.mark.parametrize("partitions", [1, 7])
def test_audit_is_the_plain_version(spark, partitions):
    docs = corpus()
    df = spark.createDataFrame([(*d, 1, "t") for d in docs], "lang string, source string, text string, n int, term string").repartition(partitions)
    got = sorted(map(tuple, divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == plain(docs)


def test_empty_table_and_other_limits(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(none).count() == 0
    docs = [("en", "a", "x y y"), ("en", "b", "x"), ("en", "c", None)]
    df = spark.createDataFrame(docs, none.schema)
    rows = sorted(map(tuple, divergence.audit(df, least_docs=1, top=1).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert rows == plain(docs, 1, 1)


def test_tree_adds_each_pair_of_sources_once():
    r = np.random.default_rng(5)
    dense = np.where(r.random((400, 6)) < 0.6, 0, r.integers(1, 4, (400, 6)))
    zero = np.array([5, 7, 11, 13, 17, 19])
    share = dense * 100 + zero
    rows = sorted(tuple((s, int(share[t, s])) for s in range(6) if dense[t, s]) for t in range(400))
    paths = sorted(Counter(rows).items())
    offsets = np.cumsum([0, *(len(x) for x, _ in paths)])
    source, p = (np.array([e[k] for x, _ in paths for e in x], np.int64) for k in (0, 1))
    a, b, v = divergence.tree_corrections(offsets, source, p, zero[source], np.array([n for _, n in paths]))
    got = {(int(x), int(y)): int(z) for x, y, z in zip(a, b, v)}
    f = divergence.fraction
    for x in range(6):
        for y in range(x + 1, 6):
            both = (dense[:, x] > 0) & (dense[:, y] > 0)
            want = (f(share[:, x], share[:, y]) - f(share[:, x], zero[y]) - f(zero[x], share[:, y]) + f(zero[x], zero[y]))[both].sum()
            assert got.get((x, y), 0) == want


def test_counts_are_merged_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    df = spark.createDataFrame(corpus(200), "lang string, source string, text string")
    want = Counter()
    for lang, source, text in corpus(200):
        want.update((lang or "", source or "", t) for t in terms_of(text))
    assert {(r.lang, r.source, r.term): r.n for r in divergence.term_counts(df).collect()} == want
