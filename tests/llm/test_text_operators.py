"""Operators on texts against plain Python, with the awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewater.llm import bpe, chat, decontaminate, linededup, ngramjoin, sharding

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, node string, start int, spans string"


def documents(spark, rows):
    """Documents whose further columns clash with names that the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [(None, "null id text"), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "Ünï Éa"), (4, "same id, other text"), (5, "repeat me"), (5, "repeat me"), (6, "z" * 50_000)]


# -- decontamination ----------------------------------------------------------------------
def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def plain_report(docs, items, n=13):
    grams = {}
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in grams:
                    hit |= set(range(i, i + size))
                    found |= grams[tuple(w[i:i + size])]
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return out


def test_decontamination_matches_loops(spark):
    items = [(1, prose(1, 40)), (2, prose(1, 20)), (10, "Short item É"), (3, None), (4, ""), (5, "one")]
    rows = [(20, "a b " + prose(1, 25) + " c"), (21, prose(9, 30).upper()), (22, "SHORT, item É! and one"), (23, prose(2, 900) + " " + prose(1, 40))]
    rows += AWKWARD
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(documents(spark, rows), bench).select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted(map(str, [(r[0], r[1], r[2], tuple(r[3])) for r in got])) == sorted(map(str, plain_report(rows, items)))


def test_decontamination_removes(spark):
    bench = spark.createDataFrame([(1, prose(1, 13))], "item_id long, text string")
    rows = [(1, "keep, this " + prose(1, 13) + ". And this"), (2, "clean"), (3, prose(4, 600) + " " + prose(1, 13)), (None, None)]
    docs = documents(spark, rows)
    assert {r.doc_id for r in decontaminate.remove_documents(docs, bench).collect()} == {2, 3, None}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert re.sub(" +", " ", cut[1]) == "keep, this . And this" and cut[2] == "clean" and cut[None] is None
    assert decontaminate.remove_documents(docs, bench).columns == docs.columns


def test_decontamination_of_nothing(spark):
    none, bench = documents(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(none, bench).count() == 0
    assert decontaminate.report(documents(spark, AWKWARD), bench).filter("n_hit > 0").count() == 0


# -- chat ---------------------------------------------------------------------------------
CHAT = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize("budget,history", [(60, 2), (200, 0), (5000, 3)])
def test_chat_round_trip(spark, budget, history):
    r = random.Random(3)
    nasty = ["\\### Assistant: </turn> ok", "<turn user>\n", "\\b\\e\\s\\", "", "</turn", "é" * 30, "x" * 3000]
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], r.choice(nasty) + prose(c * 10 + t, r.randrange(60))) for c in range(8) for t in range(r.randrange(1, 9))]
    rows += [(100, None, None, None), (100, 0, "assi>st\nant", "a"), (100, 0, "assistant", "b"), (100, 0, "assistant", "b"), (None, 0, "user", "null id"), (101, 0, "system", "alone")]
    rows += [(102, t, ("user", "assistant")[t % 2], "long") for t in range(700)]
    made = chat.format_windows(spark.createDataFrame([(*x, "extra") for x in rows], CHAT + ", block string"), budget, history, min(history * 20, budget // 2))
    read = made.select("*", chat.read_window(F.col("text")).alias("turns"), chat.read_targets(F.col("text"), F.col("targets")).alias("loss"))
    got, loss, sizes = {}, {}, []
    for w in sorted(read.collect(), key=lambda w: w.window):
        got.setdefault(w.conv_id, []).extend((t.role, t.text) for t in w.turns[w.n_repeated:])
        loss.setdefault(w.conv_id, []).extend(w.loss)
        fresh = [t for t in w.turns[w.n_repeated:] if t.role != "system"]
        sizes.append((len(fresh), sum(4 + -(-len(t.text.encode()) // 4) for t in w.turns)))
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert got == {c: [(x[2], x[3]) for x in sorted(v)] for c, v in want.items()}
    assert loss == {c: [x[3] for x in sorted(v) if x[2] == "assistant"] for c, v in want.items()}
    assert all(n == 1 or total <= budget for n, total in sizes)


def test_chat_of_nothing(spark):
    assert chat.format_windows(spark.createDataFrame([], CHAT)).count() == 0


# -- sharding -----------------------------------------------------------------------------
def smallest_capacity(sizes, n):
    def fits(c):
        shards, room = 0, 0
        for s in sizes:
            if s > room:
                shards, room = shards + 1, c
            room -= s
        return shards <= n

    return next(c for c in itertools.count(max(sizes)) if fits(c))


def test_sharding_is_minimax(spark):
    r = random.Random(5)
    rows = AWKWARD + [(100 + i, "t" * r.randrange(1, 400) + str(i % 150)) for i in range(300)] + [(1000 + i, "copy" * 20) for i in range(200)]
    out = sharding.shard(documents(spark, rows), 7).collect()
    groups, shards = {}, {}
    for i, text in rows:
        g = groups.setdefault(text or "", [(1, 0), 0])
        g[0] = min(g[0], (0 if i is None else 1, i or 0))
        g[1] += len((text or "").encode()) + 1
    filled = {}
    for d in out:
        shards.setdefault(d.shard, []).append(d.slot)
        filled[d.shard] = filled.get(d.shard, 0) + d.size
    assert len(out) == len(rows) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    with_first = {t: (min([i for i, x in rows if (x or "") == t and i is not None], default=-1)) for t in groups}
    order = sorted(groups, key=lambda t: (with_first[t], hashlib.sha256(t.encode()).digest()))
    assert max(filled.values()) == smallest_capacity([groups[t][1] for t in order], 7)
    by_text = {}
    for d in out:
        by_text.setdefault(d.text_crc32, set()).add(d.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_sharding_of_little(spark):
    assert sharding.shard(documents(spark, [])).count() == 0
    assert sorted(r.slot for r in sharding.shard(documents(spark, [(1, "a"), (1, "a"), (2, None)]), 16).collect())[0] == 0


# -- n-gram join --------------------------------------------------------------------------
def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def plain_components(rows):
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    key = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), (True, 1 << 60)), (rows[i][0] is not None, rows[i][0] or 0) if rows[i][0] is not None else (True, 1 << 60))
    return [(rows[i][0], len(sets[i]), least[root(i)][1] if sets[i] else rows[i][0]) for i in range(len(rows)) if key(i)]


def edited(text, r, share):
    return " ".join(f"e{r.randrange(10 ** 6)}" if r.random() < share else w for w in text.split())


def corpus():
    r = random.Random(8)
    rows, passage = [], prose(77, 60)
    for g in range(12):
        base = prose(1000 + g, r.randrange(20, 200), 5000)
        rows += [edited(base, r, r.choice((0, 0.005, 0.02, 0.05))) for _ in range(r.randrange(1, 25))]
    rows += [prose(2000 + i, 30, 5000) + " " + passage for i in range(60)]
    rows += ["a b c", "A b  c", "a b c d e", "a b c d e f"]
    return [(50 + i, t) for i, t in enumerate(rows)] + [(i, t) for i, t in AWKWARD if i is not None]


@pytest.mark.parametrize("common,rounds", [(32, 4), (3, 1), (3, 0)])
def test_ngram_join_matches_all_pairs(spark, monkeypatch, common, rounds):
    monkeypatch.setattr(ngramjoin, "COMMON", common)
    monkeypatch.setattr(ngramjoin, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(ngramjoin, "LEAF_BLOCK", 16)
    rows = corpus()
    got = [(r.doc_id, r.n, r.component_id) for r in ngramjoin.join(documents(spark, rows)).collect()]
    assert sorted(got) == sorted(plain_components(rows))


def test_ngram_join_keeps_one(spark):
    rows = corpus() + [(None, None), (None, "a null id")]
    docs = documents(spark, rows)
    kept = ngramjoin.keep_first(docs)
    assert kept.columns == docs.columns
    components = {c for d, n, c in plain_components(rows) if n}
    texts = [r for r in kept.collect() if shingle_set(r.text)]
    assert len(texts) == len(components) + 1  # and the one with the null id
    assert ngramjoin.join(documents(spark, [])).count() == 0


def test_tree_join_loses_no_pair():
    import numpy as np

    r = np.random.default_rng(1)
    base = r.poisson(6, (12, ngramjoin.GROUPS))
    vecs = np.maximum(np.repeat(base, 20, axis=0) + r.integers(-1, 2, (240, ngramjoin.GROUPS)), 0).astype(np.int32)
    sizes, labels = vecs.sum(1).astype(np.int64), np.arange(240) // 3
    got = {tuple(sorted(p)) for p in ngramjoin.tree_join(vecs, sizes, labels, np.arange(240), None)}
    want = {(i, j) for i, j in itertools.combinations(range(240), 2)
            if labels[i] != labels[j] and np.minimum(vecs[i], vecs[j]).sum() >= ngramjoin.required(sizes[i], sizes[j])}
    assert got == want and len(want) > 100
    two = {tuple(sorted(p)) for p in ngramjoin.tree_join(vecs, sizes, labels, np.arange(100), np.arange(100, 240))}
    assert two == {p for p in want if p[0] < 100 <= p[1]}


# -- line dedup ---------------------------------------------------------------------------
def test_line_dedup_removes_repeated_passages(spark):
    passage = [prose(i, 18) for i in range(5)]
    rows = []
    for d in range(12):
        own = [prose(500 + d * 20 + k, 12) for k in range(8)]
        rows.append((d, "\n".join(own[:4] + (passage if d % 3 == 0 else []) + own[4:])))
    rows += [(40, rows[0][1]), (41, prose(3, 60) + "\n" + prose(4, 60)), (42, "x\n" + prose(3, 60)), (None, None), (43, ""), (44, "\n\n")]
    docs = documents(spark, rows)
    cleaned = linededup.clean(docs)
    out = {r.doc_id: r.text for r in cleaned.collect()}
    assert cleaned.columns == [*docs.columns, "_removed_lines"]
    for d, text in rows:
        if d in (3, 6, 9):  # all own lines stay; of the passage at most one edge line may
            kept = out[d].split("\n")
            assert [x for x in kept if x not in passage] == [x for x in text.split("\n") if x not in passage]
            assert sum(x in passage for x in kept) <= 1
        elif d == 42:
            assert out[d] == "x"
        else:
            assert out[d] == text  # the first place, copies of whole texts, clean, null and empty ones


def test_line_chunks_do_not_shift():
    lines = [prose(i, 6) for i in range(60)]
    here = {h for _, n, h in linededup.chunks("\n".join(lines))}
    there = {h for _, n, h in linededup.chunks("\n".join(["new first line", *lines]))}
    assert len(here & there) > 0.8 * len(here)


@pytest.mark.parametrize("sizes", [(18, 18, 18), (30, 24), (30, 20, 30, 20), (20, 20), (45, 3), (3, 0, 45)])
def test_line_dedup_finds_every_passage(spark, sizes):
    rows, want = [], []
    for k in range(12):  # other lines, so other hashes: none may depend on where the cuttings fall
        passage = [prose(9000 + 50 * k + i, n) for i, n in enumerate(sizes)]
        for copy in range(2):
            own = [prose(20_000 + 20 * k + 10 * copy + i, 5) for i in range(4)]
            rows.append((2 * k + copy, "\n".join(own[:2] + passage + own[2:])))
            want.append("\n".join(own) if copy else rows[-1][1])
    got = {r.doc_id: r.text for r in linededup.clean(documents(spark, rows)).collect()}
    assert [got[i] for i in range(24)] == want


def test_line_dedup_keeps_the_first_of_repeats_within_a_text(spark):
    short, long = prose(1, 10), prose(2, 60)
    rows = [(1, "\n".join([short] * 30)), (2, "\n".join([long] * 3)), (3, "\n".join([short] * 5))]
    got = {r.doc_id: r.text for r in linededup.clean(documents(spark, rows)).collect()}
    assert got == {1: "\n".join([short] * 4), 2: long, 3: ""}


def test_line_runs_hold_just_enough_words():
    r = random.Random(8)
    for _ in range(200):
        words = [r.choice([0, 1, 7, 20, 50]) for _ in range(r.randrange(12))]
        full = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words) + 1) if sum(words[i:j]) >= 40}
        least = {(i, min(j for a, j in full if a == i)) for i, _ in full} | {(max(i for i, b in full if b == j), j) for _, j in full}
        assert {(i, i + n) for i, n in linededup.full_runs(words, 40)} == least


# -- byte-level BPE -----------------------------------------------------------------------
def test_bpe_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    theirs = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    tokens = list(ranks)
    texts = ["".join(b"".join(r.choice(tokens) for _ in range(30)).decode("utf-8", "ignore")) for _ in range(60)]
    texts += ["a" * 5000, " \n\t  x", "don't  'll é　😀", "\x1c\x1d tab\x0b", "é" * 40]
    rows = AWKWARD + [(100 + i, t) for i, t in enumerate(texts)]
    out = bpe.round_trip(documents(spark, rows), path, tokenizers.PATTERN).collect()
    apart = bpe.decode(bpe.encode(documents(spark, rows), path, tokenizers.PATTERN), path).collect()
    for d in [*out, *apart]:
        assert d.ids == theirs.encode_ordinary(d.text or "") and d.decoded == (d.text or "")
    assert bpe.encode(documents(spark, []), path, tokenizers.PATTERN).count() == 0


def test_transducer_with_tiny_caches(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cab": 259, b"aa": 260, b"aaa": 261}
    tiktoken = pytest.importorskip("tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    machine = bpe.Transducer(ranks)
    for n in range(1, 9):
        for piece in map("".join, itertools.product("abc", repeat=n) if n < 6 else [random.choices("abc", k=n) for _ in range(200)]):
            assert machine.encode(piece.encode()) == theirs.encode_ordinary(piece), piece


@pytest.mark.parametrize("data", [b"\xe2\x82", b"\xff\xfe", b"\xed\xa0\x80x", b"\xf0\x9f\x98", b"\xf4\x90\x80\x80", b"\xe0\x80\x80a", "é€😀".encode()])
def test_utf8_stream(data):
    stream = bpe.Utf8Stream()
    assert "".join(stream.feed(data[i:i + 1]) for i in range(len(data))) + stream.end() == data.decode("utf-8", "replace")
