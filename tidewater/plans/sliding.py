"""Drawdowns of return paths as a monoid: folded over slices, and sliding over windows without storing them.

A path of returns reduces to (growth, top, bottom, fall): its total factor, its highest and lowest value on the way
(starting from 1, the start itself not counted) and its deepest relative fall. Two paths one after the other reduce to

    growth = g1 g2    top = max(t1, g1 t2)    bottom = min(b1, g1 b2)    fall = min(f1, f2, g1 b2 / t1 - 1)

where f2 is 0 once the value is 0.
There is no inverse, so a sliding window can't drop its oldest return; instead positions are cut into blocks of the window's
length, and every window is the fold of a block's end (folded from the right) with the next block's beginning (folded from
the left). A return of -1 or below ends the path's value at 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.plans.timeline import Timeline

Path = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _single(ret: np.ndarray) -> Path:
    g = np.maximum(1 + ret, 0.0)
    return g, g, g, np.zeros_like(g)


def _then(x: Path, y: Path) -> Path:
    low = x[0] * y[2]
    with np.errstate(divide="ignore", invalid="ignore"):
        fall = np.where(x[1] > 0, low / x[1] - 1, 0.0)
    return x[0] * y[0], np.maximum(x[1], x[0] * y[1]), np.minimum(x[2], low), np.minimum(np.minimum(x[3], np.where(x[0] > 0, y[3], 0.0)), fall)


def sliding_falls(ret: np.ndarray, n: int) -> np.ndarray:
    """Deepest fall inside each full window of ``n`` returns; NaN before the first full one."""
    size = len(ret)
    out = np.full(size, np.nan)
    if size < n:
        return out
    blocks = -(-size // n)
    cells = np.zeros((blocks, n))
    cells.ravel()[:size] = ret
    ends: list[Path] = [_single(cells[:, n - 1])]
    for k in range(n - 2, -1, -1):
        ends.append(_then(_single(cells[:, k]), ends[-1]))
    ends.reverse()  # ends[k]: returns k to n - 1 of every block
    falls = np.full((blocks, n), np.nan)
    falls[:, n - 1] = ends[0][3]
    head: Path | None = None
    for k in range(n - 1):  # window that ends at return k of the next block
        one = _single(cells[1:, k])
        head = one if head is None else _then(head, one)
        falls[1:, k] = _then(tuple(v[:-1] for v in ends[k + 1]), head)[3]
    out[n - 1:] = falls.ravel()[n - 1:size]
    return out


def rolling_falls(tl: Timeline, col: str, windows: tuple[int, ...]) -> DataFrame:
    """(key, window_bars, n, falls): number and sum of the deepest falls of all full windows in each chunk.

    ``tl`` needs a halo of ``max(windows) - 1`` rows before each chunk and no NULL in ``col``.
    """
    key = tl.keys[0]
    kind = tl.df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__at")
        own, ret = pdf["__mine"].to_numpy(), pdf["__r"].to_numpy()
        found = [sliding_falls(ret, n)[own] for n in windows]
        return pd.DataFrame({key: pdf[key].iloc[0], "window_bars": list(windows), "n": [int(np.isfinite(f).sum()) for f in found], "falls": [float(np.nansum(f)) for f in found]})

    rows = tl.df.select(*tl.part, tl.pos.alias("__at"), tl.own.alias("__mine"), F.col(col).alias("__r"))
    return rows.groupBy(*tl.part).applyInPandas(run, f"{key} {kind}, window_bars int, n long, falls double")


def slice_paths(tl: Timeline, col: str) -> DataFrame:
    """(parts of the timeline, path): the path of every slice, by windows inside the slice."""
    growth = F.greatest(1 + F.col(col), F.lit(0.0))
    w = tl.window(None, 0)
    tl = tl.add(__v=F.product(growth).over(w))
    tl = tl.add(__t=F.max("__v").over(w))
    fall = F.when(F.col("__t") > 0, F.col("__v") / F.col("__t") - 1).otherwise(F.lit(0.0))
    path = F.struct(F.product(growth).alias("growth"), F.max("__v").alias("top"), F.min("__v").alias("bottom"), F.min(fall).alias("fall"))
    return tl.df.groupBy(*tl.part).agg(path.alias("path"))


def folded_fall(paths: Column) -> Column:
    """Deepest fall of an array of consecutive paths."""
    zero = F.struct(F.lit(1.0).alias("growth"), F.lit(0.0).alias("top"), F.lit(0.0).alias("fall"))

    def step(s, p):
        low = s["growth"] * p["bottom"]
        fall = F.when(s["top"] > 0, low / s["top"] - 1).otherwise(F.lit(0.0))
        return F.struct((s["growth"] * p["growth"]).alias("growth"), F.greatest(s["top"], s["growth"] * p["top"]).alias("top"), F.least(s["fall"], F.when(s["growth"] > 0, p["fall"]).otherwise(0.0), fall).alias("fall"))

    return F.aggregate(paths, zero, step, lambda s: s["fall"])
