"""Parameter sweeps, Pareto fronts, crowding, hypervolume, convergence."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import ratio, uniform
from tidewater.operators import metrics as m
from tidewater.operators.features import bars_timeline
from tidewater.operators.trades import stream_in_order
from tidewater.plans.attach import attach, value_slices
from tidewater.plans.timeline import lay_out
from tidewater.session import settle


# -- grids and sweeps ---------------------------------------------------------------------
def parameter_grid(values: DataFrame) -> DataFrame:
    """All combinations of the value lists in one row of arrays, by successive explodes."""
    out = values
    for c in values.columns:
        out = out.withColumn(c, F.explode(c))
    return out


def sample_parameters(draws: DataFrame, id_col: str, ranges: dict[str, tuple], seed: int = 1) -> DataFrame:
    """Random parameters per draw: (lo, hi) floats, (lo, hi, 'int') integers, ('pick', [..]) choices."""
    cols = {}
    for name, spec in ranges.items():
        u = uniform(id_col, F.lit(name), F.lit(seed))
        if spec[0] == "pick":
            options = F.array(*[F.lit(o) for o in spec[1]])
            cols[name] = F.element_at(options, (F.floor(u * len(spec[1])) + 1).cast("int"))
        elif len(spec) == 3:
            cols[name] = (F.floor(u * (spec[1] - spec[0] + 1)) + spec[0]).cast("long")
        else:
            cols[name] = u * (spec[1] - spec[0]) + spec[0]
    return draws.select(id_col).withColumns(cols)


def evaluate(candidates: DataFrame, objectives, schema: str) -> DataFrame:
    """A caller's vectorised Python objective: batches of candidates in, batches of values out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield objectives(pdf)

    return candidates.mapInPandas(run, schema)


def ma_cross_returns(bars: DataFrame, params: list[tuple[int, int]]) -> DataFrame:
    """Strategy return per bar and parameter set.

    The bars are laid out once and every distinct window length is one column; rows multiply by
    the parameter sets only after the windows, on the way into the aggregation.
    """
    lengths = sorted({n for p in params for n in p})
    tl = bars_timeline(bars, back=max(lengths) + 1)
    tl = tl.add(ret=ratio(F.col("close"), tl.lag("close")) - 1, **{f"__s{n}": tl.full(F.avg, "close", n) for n in lengths})
    tl = tl.add(**{f"__p{f}_{s}": tl.lag(F.signum(F.col(f"__s{f}") - F.col(f"__s{s}"))) for f, s in params})
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), (F.col(f"__p{f}_{s}") * F.col("ret")).alias("strategy_ret")) for f, s in params]))
    return tl.rows().select("symbol", "ts", each)


def sweep_report(returns: DataFrame) -> DataFrame:
    r = F.col("strategy_ret")
    return returns.where("strategy_ret IS NOT NULL").groupBy("fast", "slow", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum(r).alias("total"), m.sharpe(r).alias("sharpe"), F.avg((r > 0).cast("double")).alias("win_rate"))


def cross_validated(returns: DataFrame, folds: DataFrame) -> DataFrame:
    """Mean and spread over test folds of the mean strategy return, per parameter set and symbol."""
    x = folds.where("role = 'test'").select("symbol", "ts", "fold").join(returns, ["symbol", "ts"])
    f = x.groupBy("fast", "slow", "symbol", "fold").agg(F.avg("strategy_ret").alias("s"))
    return f.groupBy("fast", "slow", "symbol").agg(F.avg("s").alias("score"), F.stddev_pop("s").alias("spread"))


def repeated_trials(trials: DataFrame, params: list[str]) -> DataFrame:
    return trials.groupBy(*params).agg(F.count(F.lit(1)).alias("trials"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def best_combination(summary: DataFrame, params: list[str]) -> DataFrame:
    row = F.max_by(F.struct(*params, "mean"), F.struct("mean", *params))
    return summary.agg(row.alias("r")).select("r.*")


def sensitivity(trials: DataFrame, params: list[str], metrics: list[str]) -> DataFrame:
    """Mean metrics per value of each parameter."""
    each = F.inline(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("long").alias("value")) for p in params]))
    return trials.select(*metrics, each).groupBy("param", "value").agg(*[F.avg(x).alias(x) for x in metrics])


def running_best(trials: DataFrame, key: str, order: str, score: str, slice_width: int = 100_000) -> DataFrame:
    tl = lay_out(trials, key, [order], F.floor(F.col(order) / slice_width))
    return tl.running(best=("max", score)).rows()


def convergence(trials: DataFrame, key: str, order: str, score: str, patience: int = 10, tolerance: float = 1e-3, slice_width: int = 100_000) -> DataFrame:
    """Converged when the best score moved less than ``tolerance`` over the last ``patience`` trials."""
    best = settle(running_best(trials, key, order, score, slice_width), "best")
    tl = lay_out(best, key, [order], F.floor(F.col(order) / slice_width), back=patience)
    return tl.add(converged=F.coalesce(F.col("best") - tl.lag("best", patience) < tolerance, F.lit(False))).rows()


def sobol_indices(draws: DataFrame, id_col: str, names: list[str], objective, seed: int = 3) -> DataFrame:
    """First-order and total sensitivity by the A / B / AB sampling scheme, one row per parameter.

    ``objective`` maps a dict of columns to a column.
    """
    a = {n: uniform(id_col, F.lit(n), F.lit("a"), F.lit(seed)) for n in names}
    b = {n: uniform(id_col, F.lit(n), F.lit("b"), F.lit(seed)) for n in names}
    x = draws.select(id_col).withColumns({"fa": objective(a), "fb": objective(b), **{f"ab_{n}": objective({**a, n: b[n]}) for n in names}})
    fa, fb = F.col("fa"), F.col("fb")
    n2 = 2.0 * F.count(F.lit(1))
    var = F.sum(fa * fa + fb * fb) / n2 - F.pow(F.sum(fa + fb) / n2, 2)
    parts = [
        F.struct(
            F.lit(n).alias("param"), ratio(F.avg(fb * (F.col(f"ab_{n}") - fa)), var).alias("s1"),
            ratio(F.avg(F.pow(fa - F.col(f"ab_{n}"), 2)) / 2, var).alias("st"))
        for n in names
    ]
    return x.agg(F.array(*parts).alias("p")).select(F.inline("p"))


# -- Pareto -------------------------------------------------------------------------------
def pareto_front(cands: DataFrame, id_col: str, x: str, y: str, strict: bool = True) -> DataFrame:
    """Candidates (both objectives maximised) no other candidate dominates.

    ``strict``: a dominator is better in both objectives; otherwise at least as good in both and
    better in one. Sorted by x, a candidate is dominated exactly when a running maximum of y over
    better x values exceeds it, so no pairs are formed: values of x are folded to their best y
    and scanned once.
    """
    best = cands.groupBy(F.lit(0).alias("__all"), F.col(x).alias("__x")).agg(F.max(y).alias("__top"))
    best = settle(best, "steps")
    tl = lay_out(value_slices(best, "__all", "__x", descending=True), "__all", [F.desc("__x")], F.col("__vs"))
    prior = settle(tl.running(__prior=("max<", "__top")).rows().select("__x", "__top", "__prior"), "prior")
    j = cands.join(prior, F.col(x) == F.col("__x"))
    if strict:
        dominated = F.col("__prior") > F.col(y)
    else:
        dominated = (F.col("__prior") >= F.col(y)) | (F.col("__top") > F.col(y))
    return j.where(~F.coalesce(dominated, F.lit(False))).drop("__x", "__top", "__prior")


def front_ranks(cands: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Non-dominated rank (0 = front) of every candidate in its population, both objectives minimised.

    Sorted by (x, y), the rank of a point is the length of the longest chain of points that
    dominate one another before it, which one ordered pass finds with a sorted list of the best y
    per rank. Equal points share a rank and are folded first. The state is one number per front.
    """
    points = cands.select(F.col(key).cast("string").alias("__k"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).distinct()

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, tails = None, []
        for pdf in batches:
            out = []
            for k, v in zip(pdf["__k"], pdf["__y"]):
                if k != key_now:
                    key_now, tails = k, []
                r = bisect.bisect_right(tails, v)
                if r == len(tails):
                    tails.append(v)
                else:
                    tails[r] = v
                out.append(r)
            yield pdf.assign(rank=out)

    ranked = stream_in_order(points, "__k", ["__x", "__y"], ranks, "__k string, __x double, __y double, rank long")
    cond = (F.col(key).cast("string") == F.col("__k")) & (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y"))
    return cands.join(ranked, cond).drop("__k", "__x", "__y")


def crowding(ranked: DataFrame, keys: list[str], id_col: str, objectives: list[str]) -> DataFrame:
    """Crowding distance within each front; the ends of an objective are infinitely far."""
    out = settle(ranked, "ranked")
    span = out.groupBy(*keys).agg(*[(F.max(o) - F.min(o)).alias(f"__r_{o}") for o in objectives])
    for o in objectives:
        x = value_slices(out, keys, o, slices=16)
        tl = lay_out(x, keys, [o, id_col], F.col("__vs"), back=1, ahead=1)
        out = settle(tl.add(**{f"__g_{o}": tl.lead(o) - tl.lag(o)}).rows().drop("__vs"), "gaps")
    out = attach(out, span, keys)
    total = sum((F.coalesce(ratio(f"__g_{o}", f"__r_{o}"), F.when(F.col(f"__r_{o}") == 0, 0.0)) for o in objectives[1:]),
                F.coalesce(ratio(f"__g_{objectives[0]}", f"__r_{objectives[0]}"), F.when(F.col(f"__r_{objectives[0]}") == 0, 0.0)))
    edge = F.lit(False)
    for o in objectives:
        edge = edge | F.col(f"__g_{o}").isNull()
    out = out.withColumns({"boundary": edge, "crowding": F.when(edge, F.lit(float("inf"))).otherwise(total)})
    return out.drop(*[f"__{p}_{o}" for p in "gr" for o in objectives])


def hypervolume(front: DataFrame, x: str, y: str, samples: int = 10_000, margin: float = 1.1, seed: int = 9) -> DataFrame:
    """Share of the box below the reference point (margin · max, minimising) that the front dominates.

    Sample points and front are stacked and sorted by x; a sample is dominated when the running
    minimum of the front's y is at or below it.
    """
    box = settle(front.agg((F.max(x) * margin).alias("rx"), (F.max(y) * margin).alias("ry"), F.min(x).alias("lx"), F.min(y).alias("ly")), "box")
    pick = lambda c: box.select(c).scalar()
    u = front.sparkSession.range(samples).select(
        F.lit(0).alias("__all"), (pick("lx") + uniform("id", F.lit("x"), F.lit(seed)) * (pick("rx") - pick("lx"))).alias("x"),
        (pick("ly") + uniform("id", F.lit("y"), F.lit(seed)) * (pick("ry") - pick("ly"))).alias("y"), F.lit(1).alias("kind"))
    f = front.select(F.lit(0).alias("__all"), F.col(x).alias("x"), F.col(y).alias("y"), F.lit(0).alias("kind"))
    both = settle(f.unionByName(u), "points")
    tl = lay_out(value_slices(both, "__all", "x"), "__all", ["x", "kind", "y"], F.col("__vs"))
    s = tl.running(__low=("min", F.when(F.col("kind") == 0, F.col("y")))).rows().where("kind = 1")
    share = s.agg(F.avg(F.coalesce(F.col("__low") <= F.col("y"), F.lit(False)).cast("double")).alias("share"))
    volume = (pick("rx") - pick("lx")) * (pick("ry") - pick("ly"))
    return share.withColumn("hypervolume", F.col("share") * volume)
