"""Pivot rounds of the n-gram join: no more pairs than nodes, and no link lost in a large group of near copies."""

import random

from tidewater.llm import ngramjoin


def test_a_round_asks_one_pair_per_node(spark):
    r = random.Random(1)
    rows = [(s, n, n) for s in range(40) for n in r.sample(range(60), 30)]
    open_ = spark.createDataFrame(rows, "shingle long, node long, label long")
    pivots = ngramjoin.bucket_pivots(open_, 0)
    assert pivots.count() == 40 and pivots.agg({"size": "max"}).first()[0] == 30
    asked = ngramjoin.one_pivot(open_.join(pivots, "shingle").filter("label <> p_label"))
    assert 30 <= asked.count() <= 60


def test_large_group_of_near_copies(spark, monkeypatch):
    asked = []
    real = ngramjoin.verified
    monkeypatch.setattr(ngramjoin, "verified", lambda pairs, sets: (asked.append(pairs.count()), real(pairs, sets))[1])
    r = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(300):
        words = list(base)
        for _ in range(r.randrange(0, 6)):
            words[r.randrange(150)] = f"x{r.randrange(10_000)}"
        docs.append((i, " ".join(words)))
    got = {x.doc_id: x.component_id for x in ngramjoin.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}

    def shingles(text):
        w = text.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets, label = [shingles(t) for _, t in docs], list(range(300))
    for i in range(300):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert [got[i] for i in range(300)] == label
    assert sum(asked) < 20 * 300


def test_links_between_components_count_once(spark, monkeypatch):
    """A group whose pairs are nearly all links: neither verified pairs nor followed links grow with its square."""
    asked, followed = [], []
    verified, components = ngramjoin.verified, ngramjoin.components
    monkeypatch.setattr(ngramjoin, "STAR_ROUNDS", 0)
    monkeypatch.setattr(ngramjoin, "verified", lambda pairs, sets: (asked.append(pairs.count()), verified(pairs, sets))[1])
    monkeypatch.setattr(ngramjoin, "components", lambda links: (followed.append(links.count()), components(links))[1])
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(160):
        words = list(base)
        words[r.randrange(200)] = f"x{i}"
        docs.append((i, " ".join(words)))
    got = {x.doc_id: x.component_id for x in ngramjoin.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(160), 0)
    assert sum(asked) < 20 * 160 and sum(followed) < 20 * 160  # of 12 720 pairs


def test_links_tie_components_not_nodes(spark, monkeypatch):
    followed = []
    components = ngramjoin.components
    monkeypatch.setattr(ngramjoin, "components", lambda links: (followed.append(links.count()), components(links))[1])
    labels = spark.createDataFrame([(n, n - n % 10) for n in range(40)], "node long, label long")
    monkeypatch.setattr(ngramjoin, "drop_written", lambda *a: None)
    links = spark.createDataFrame([(a, b) for a in range(10) for b in range(10, 20)] + [(25, 90), (50, 60)], "a long, b long")
    got = {x.node: x.label for x in ngramjoin.tied(labels, links).collect()}
    assert got == {n: 0 for n in range(20)} | {n: n - n % 10 for n in range(20, 40)} | {90: 20, 50: 50, 60: 50}
    assert followed == [3]
