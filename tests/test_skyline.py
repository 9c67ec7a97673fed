"""Fronts over several objectives against all pairs."""

import numpy as np
import pytest

from tidewater.plans import skyline


def plain(points, strict):
    out = []
    for i, p in enumerate(points):
        if not any(((q > p).all() if strict else (q >= p).all() and (q > p).any()) for q in points):
            out.append(i)
    return set(out)


@pytest.mark.parametrize("k, kind", [(2, "ties"), (3, "free"), (3, "sphere"), (4, "ties")])
def test_front_is_all_pairs(spark, monkeypatch, k, kind):
    monkeypatch.setattr(skyline, "BLOCK", 16)
    r = np.random.default_rng(k)
    x = r.random((400, k)) if kind != "ties" else r.integers(0, 7, (400, k)).astype(float)
    if kind == "sphere":  # most points are on the front
        x = np.concatenate((x[:50] * 0.3, np.abs(r.normal(size=(250, k)))))
        x[50:] /= np.linalg.norm(x[50:], axis=1, keepdims=True)
    rows = [(i, *map(float, p)) for i, p in enumerate(x)] + [(1000, None, *[9.0] * (k - 1)), (1001, *map(float, x[0])), (1001, *map(float, x[0]))]
    names = [f"o{i}" for i in range(k)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    for strict in (True, False):
        want = plain(x, strict)
        want = sorted([*want, *([1001, 1001] if 0 in want else [])])
        assert sorted(i.id for i in skyline.skyline(df, names, strict).collect()) == want


def test_peeled_fronts_and_shares(spark):
    r = np.random.default_rng(9)
    x = r.integers(0, 20, (120, 3)).astype(float)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, a double, b double, c double")
    got = {i.id: i["rank"] for i in skyline.fronts(df, ["a", "b", "c"], 3).collect()}
    left, want = list(range(120)), {}
    for rank in range(3):
        front = [left[i] for i in plain(x[left], False)]
        want |= {i: rank for i in front}
        left = [i for i in left if i not in front]
    assert got == want
    samples = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(r.random((200, 3)) * 20)], "id long, a double, b double, c double")
    share = skyline.dominated_share(df, ["a", "b", "c"], samples).first()[0]
    assert share == np.mean([(x >= np.array(s[1:])).all(1).any() for s in samples.collect()])


def test_empty(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert skyline.skyline(df, ["a", "b"]).count() == 0
    assert skyline.skyline(spark.createDataFrame([(None, 1.0)], df.schema), ["a", "b"]).count() == 0
