"""Trained operators, vector search and url filters against plain loops and on held-out rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import neighbours, pseudolikelihood, toxicity, urls
from tidewater.llm.words import LETTERS, NOT_BLANK, Batch, shingles, slices


# -- words --------------------------------------------------------------------------------
def test_words_do_not_cross_rows():
    batch = Batch(pa.array(["ab", "c", None, "", "AB C"]), NOT_BLANK)
    assert batch.bounds.tolist() == [0, 1, 2, 2, 2, 4]
    assert batch.hash[0] == batch.hash[2] and batch.hash[1] == batch.hash[3] and batch.hash[0] != batch.hash[1]
    assert [len(s) for s in shingles(Batch(pa.array(["a b c d e a b c d e", "a b", ""]), NOT_BLANK))] == [5, 1, 0]
    column = pa.array(["x" * 100, None, "y" * 3_000_000, ""])
    assert list(slices(column)) == [(0, 2), (2, 4)] or sum(j - i for i, j in slices(column)) == 4


# -- toxicity -----------------------------------------------------------------------------
def labelled(spark, n=700):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = [f"w{r.randrange(3000)}" for _ in range(r.randrange(20, 120))]
        for _ in range(3 * bad):
            w[r.randrange(len(w))] = r.choice(["grimble", "snark" + str(r.randrange(50)), "vex"])
        docs.append((i, " ".join(w), ("en", "de", None)[i % 3], 0.0))
        labels.append((i, int(bad)))
    docs += [(None, None, "en", 1.0), (10_000, "", "xx", 1.0), (10_001, "vex " * 30_000, "en", 1.0), (0, docs[0][1], "en", 1.0)]
    labels += [(None, 1), (3, None), (10_000_000, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    held = lambda c: c % 3 == 1
    net = toxicity.train(docs, labels, held_out=held)
    out = toxicity.score(docs, net, to="p").collect()
    assert len(out) == 704 and all(0 <= r.p <= 1 for r in out)
    unseen = [r for r in out if r.doc_id is not None and r.doc_id < 700 and r.doc_id % 3 == 1]
    right = sum((r.p >= 0.7) == (r.doc_id % 5 == 0) for r in unseen)
    assert right >= 0.95 * len(unseen)
    assert next(r.toxic for r in out if r.doc_id == 10_001) and not next(r.toxic for r in out if r.doc_id == 10_000)


def test_toxicity_score_is_the_network(spark):
    docs, labels = labelled(spark, 120)
    net = toxicity.train(docs, labels)
    for row in toxicity.score(docs.filter("doc_id < 20"), net, to="p").collect():
        ids, _ = toxicity.features(Batch(pa.array([row.text]), LETTERS, toxicity.PREFIXES))
        x = [sum(net.embed[j].astype(float) for j in i) for i in ids]
        top = [max(sum(x[p + j] @ f[j][:, c] for j in range(len(f))) for p in range(len(ids) - len(f) + 1)) for f in net.filters for c in range(toxicity.FILTERS)]
        z = sum(max(t + b, 0) * o for t, b, o in zip(top, net.bias, net.out)) + net.shift
        assert math.isclose(row.p, 1 / (1 + math.exp(-z)), abs_tol=1e-4)


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 20)
    assert toxicity.train(docs, labels.filter("toxic = 0")) is None
    assert {(r.p, r.toxic) for r in toxicity.score(docs, None, to="p").collect()} == {(0.0, False)}
    assert toxicity.train(docs.limit(0), labels) is None


# -- pseudo-likelihood --------------------------------------------------------------------
def test_pseudo_likelihood_is_the_sum_over_tokens(spark):
    r = random.Random(6)
    rows = [(i, " ".join(f"w{min(r.randrange(40), r.randrange(40))}" for _ in range(r.randrange(1, 60))), 0) for i in range(80)] + [(None, None, 0), (90, "", 0), (91, "single", 0), (91, "single", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    net = pseudolikelihood.train(docs)
    embed, w, b, wc, bc, ww, bw = [p.astype(float) for p in net.params]
    softmax = lambda z: np.exp(z) / np.exp(z).sum()
    for row in pseudolikelihood.score(docs, net).collect():
        padded, place = net.tokens(Batch(pa.array([row.text], pa.string()), LETTERS))
        total = 0.0
        for p in place:
            h = np.tanh(np.concatenate([embed[padded[p + o]] for o in pseudolikelihood.OFFSETS]) @ w + b)
            kind, inside = divmod(int(padded[p]), pseudolikelihood.PER_CLASS)
            total += math.log(softmax(h @ wc + bc)[kind] * softmax(h @ ww[kind] + bw[kind])[inside])
        assert row.n_tokens == len(place) and math.isclose(row.log_prob, total, rel_tol=1e-4, abs_tol=1e-6)
        assert row.mean_log_prob is None if not len(place) else math.isclose(row.mean_log_prob, total / len(place), rel_tol=1e-4)


def test_pseudo_likelihood_learns(spark):
    r = random.Random(1)
    rows = [(i, " ".join(f"a{k % 7} b{k % 7}" for k in range(r.randrange(7), 60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = pseudolikelihood.Window.fresh(np.zeros(0, np.uint64))
    mean = lambda net: pseudolikelihood.score(docs, net).agg({"mean_log_prob": "avg"}).first()[0]
    assert mean(pseudolikelihood.train(docs)) > mean(before) + 2
    assert pseudolikelihood.score(docs.limit(0), pseudolikelihood.train(docs.limit(0))).count() == 0


def test_pseudo_likelihood_counts_all_words(spark):
    docs = spark.createDataFrame([("b a a",), ("A c",), (None,)], "text string")
    assert sorted(r.n for r in pseudolikelihood.word_counts(docs).collect()) == [1, 1, 3]


@pytest.mark.parametrize("local", [0, 50, 65_536])
def test_pseudo_likelihood_tells_words_of_a_bucket_apart(spark, local):
    r = random.Random(7)
    rows = [(i, " ".join(f"w{min(r.randrange(6000), r.randrange(6000))}" for _ in range(r.randrange(60)))) for i in range(400)] + [(None, None), (1, ""), (2, "Never seen unheardof"), (2, "Never seen unheardof")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = pseudolikelihood.word_counts(docs.filter("text not like 'Never%'"))
    net = pseudolikelihood.train(docs, counts=counts)
    n = {np.int64(x.word).astype(np.uint64): x.n for x in counts.collect()}
    bucket = lambda h: int(h >> np.uint64(33)) % pseudolikelihood.BUCKETS
    known, tokens = set(net.words), {}
    for h, k in n.items():
        if h not in known:
            tokens[bucket(h)] = tokens.get(bucket(h), 0) + k + 1
    got = sorted(pseudolikelihood.score(docs, net, counts=counts, local=local).collect(), key=str)
    plain = sorted(pseudolikelihood.score(docs, net).collect(), key=lambda x: str(x[:2]))
    assert len(got) == len(rows) and len(n) > 1500
    for a, b in zip(sorted(got, key=lambda x: str(x[:2])), plain):
        h = [h for h in Batch(pa.array([a.text], pa.string()), LETTERS).hash if h not in known]
        extra = sum(math.log((n.get(x, 0) + 1) / (tokens.get(bucket(x), 0) + 1)) for x in h)
        assert a[:3] == b[:3] and math.isclose(a.log_prob, b.log_prob + extra, rel_tol=1e-9, abs_tol=1e-9)
        assert a.mean_log_prob is None if not a.n_tokens else math.isclose(a.mean_log_prob, a.log_prob / a.n_tokens)


# -- neighbours ---------------------------------------------------------------------------
def plain_nearest(rows, k):
    good = {i: np.array(v, float) for i, v in rows if v is not None and i is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in good:
        if q % 5 == 0:
            order = sorted((-float((good[i] * good[q]).sum()), i) for i in good if i != q)
            out[q] = [(i, -s) for s, i in order[:k]]
    return out


def test_neighbours_with_full_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 64)
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.4 * r.normal(size=8) * (1 + i % 3)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7), (2003, [float("nan")] * 8), (2004, [None] * 8), (5, rows[5][1])]
    frame = spark.createDataFrame([(*x, 9) for x in rows], "vec_id long, embedding array<float>, level int")
    got = {}
    for x in neighbours.nearest(frame, neighbours.F.col("vec_id") % 5 == 0, k=10, recall=1.0).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    want = plain_nearest(rows, 10)
    assert set(got) == set(want)
    hits = 0
    for q, near in got.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, len(near) + 1)) and [(-n[2], n[1]) for n in near] == sorted((-n[2], n[1]) for n in near)
        assert all(n[1] != q for n in near) and len(near) == 10
        hits += len({n[1] for n in near} & {i for i, _ in want[q]})
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_neighbours_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.5, 0.5]), (7, [1.0, 0.0])], schema)
    got = sorted((x.query_id, x["rank"], x.vec_id) for x in neighbours.nearest(few, neighbours.F.col("vec_id") % 5 == 0).collect())
    assert got == [(0, 1, 7), (0, 2, 5), (5, 1, 0), (5, 2, 7)]
    assert neighbours.nearest(few.limit(0), neighbours.F.col("vec_id") % 5 == 0).count() == 0
    assert neighbours.nearest(few.filter("vec_id = 0"), neighbours.F.col("vec_id") % 5 == 0).count() == 0


def test_prefix_spans():
    codes = np.sort(np.random.default_rng(3).integers(0, 2 ** 63, 500, dtype=np.uint64) * np.uint64(2))
    for bits in (0, 1, 5, 64):
        a, b = neighbours.spans(codes, codes[:20], bits)
        for i in range(20):
            same = [j for j in range(500) if bits == 0 or codes[j] >> np.uint64(64 - bits) == codes[i] >> np.uint64(64 - bits)]
            assert (a[i], b[i]) == (same[0], same[-1] + 1)


# -- urls ---------------------------------------------------------------------------------
def plain_verdicts(pages):
    def split(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        path = rest[end:]
        cut = next((i for i, c in enumerate(path) if c in "?#"), len(path))
        return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:cut]

    parts, edges, ruled = [split(u) for _, u, _ in pages], {}, []
    for host, path in parts:
        fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        ruled.append(max(fit)[1:] if fit else (None, None))
    for (host, _), (_, _, links) in zip(parts, pages):
        for link in links:
            to = split(link)[0]
            if host and to and to != host:
                edges[host, to] = edges.get((host, to), 0) + 1
    hosts = {h for h, _ in parts if h}
    n = {h: sum(p[0] == h for p in parts) for h in hosts}
    seed = lambda kind: {h: sum(p[0] == h and v[1] == kind for p, v in zip(parts, ruled)) / n[h] for h in hosts}

    def rank(seed, edges, rounds=12, d=0.85):
        out = {}
        for (a, _), c in edges.items():
            out[a] = out.get(a, 0) + c
        start = {h: (1 - d) * s for h, s in seed.items() if s > 0}
        score = dict(start)
        for _ in range(rounds):
            new = dict(start)
            for (a, b), c in edges.items():
                if a in score:
                    new[b] = new.get(b, 0) + d * c / out[a] * score[a]
            score = new
        return score

    trust, distrust = rank(seed("allow"), edges), rank(seed("block"), {(b, a): c for (a, b), c in edges.items()})
    return [(p[0], *parts[i], ruled[i][0], ruled[i][1] or ("block" if distrust.get(parts[i][0], 0) > trust.get(parts[i][0], 0) else "allow")) for i, p in enumerate(pages)]


def test_urls_match_plain_page_rank(spark):
    r = random.Random(9)
    hosts = ["a.com", "B.example.org", "c.net", "d.net", "m.e.com", "f.io", "example.org", "g.net"]
    pages = []
    for i in range(120):
        links = [f"http://{r.choice(hosts)}/x" for _ in range(r.randrange(4))] + ["/own", "//f.io/y"][: r.randrange(3)]
        pages.append((i, f"https://{r.choice(hosts)}/{r.choice(['fr', 'de', 'es', 'en'])}/{r.randrange(30)}?q=1#z", links))
    pages += [(200, None, []), (201, "no scheme", []), (202, "http://", []), (203, "x://h?y", []), (204, "http://org/", []), (3, pages[3][1], pages[3][2])]
    html = lambda links: None if not links else "<p>" + "".join(f"<a class=k href='{x}'>t</a>" for x in links)
    frame = spark.createDataFrame([(i, u, html(x), "h", 1) for i, u, x in pages], "page_id long, url string, html string, host string, links int")
    absolute = [(i, u, ["http:" + x if x.startswith("//") else x for x in links]) for i, u, links in pages]
    got = [(x.page_id, x.host, x.path, x.rule, x.verdict) for x in urls.judge(frame).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_verdicts(absolute)))
    assert len({x[4] for x in got if x[3] is None}) == 2
    assert urls.judge(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_shard", "op2_chat", "op3_ngram_join", "op4_decontaminate", "op5_byte_bpe", "op6_pseudo_likelihood", "op7_line_dedup", "op8_toxicity", "op9_neighbours", "op10_link_graph", "pipeline"])
def test_registered(name):
    from __spark_entry__ import queries

    assert name in queries()
