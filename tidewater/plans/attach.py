"""Statistics per key, exact quantiles, and joining them back onto rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.plans.timeline import join_keys
from tidewater.session import settle

SKETCH_ACCURACY = 100_000


def attach(df: DataFrame, stats: DataFrame, keys: list[str] | str) -> DataFrame:
    """Join per-key statistics onto rows.

    The statistics are settled first, so the planner sees their true size: below the broadcast
    threshold the rows are not shuffled at all, above it the join is shuffled and AQE splits the
    partitions of hot keys.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    return join_keys(df, settle(stats, "stats"), keys, "left")


def quantiles(df: DataFrame, keys: list[str] | str, col: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one output column per entry of ``probs``.

    ``percentile`` would build one value map per key in a single task. Here a bounded sketch
    gives each wanted rank a bracket of values; rows below the bracket are only counted and rows
    inside are counted per distinct value, so what reaches one task is the small bracket.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    src = df.select(*keys, F.col(col).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    slack = 2.0 / SKETCH_ACCURACY
    lo = [max(0.0, p - slack) for p in probs.values()]
    hi = [min(1.0, p + slack) for p in probs.values()]
    m = len(lo)
    sketch = src.groupBy(*keys).agg(
        F.percentile_approx("__v", lo + hi, SKETCH_ACCURACY).alias("__q"),
        F.count(F.lit(1)).alias("__n"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(float(p)).alias("p"),
                (F.col("__min") if lo[i] == 0.0 else F.col("__q")[i]).alias("lo"),
                (F.col("__max") if hi[i] == 1.0 else F.col("__q")[m + i]).alias("hi"),
            )
            for i, p in enumerate(probs.values())
        ]
    )
    bounds = settle(sketch.select(*keys, "__n", wanted.alias("__w")), "brackets")

    rows = join_keys(src, bounds, keys)
    below = rows.groupBy(*keys).agg(
        F.max("__n").alias("__n"),
        *[F.count_if(F.col("__v") < F.col("__w")[i]["lo"]).alias(f"__b{i}") for i in range(m)],
        *[F.max(F.when(F.col("__v") < F.col("__w")[i]["lo"], F.col("__v"))).alias(f"__u{i}") for i in range(m)],
        *[F.min(F.when(F.col("__v") > F.col("__w")[i]["hi"], F.col("__v"))).alias(f"__o{i}") for i in range(m)],
    )
    inside = (
        rows.select(*keys, "__v", F.explode("__w").alias("w"))
        .where(F.col("__v").between(F.col("w.lo"), F.col("w.hi")))
        .groupBy(*keys, F.col("w.i").alias("__i"), F.col("w.p").alias("__p"), "__v")
        .agg(F.count(F.lit(1)).alias("__k"))
    )
    upto = Window.partitionBy(*keys, "__i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    per_prob = lambda c: F.element_at(F.array(*[F.col(f"{c}{i}") for i in range(m)]), F.col("__i") + 1)
    start = per_prob("__b")
    ranked = (
        join_keys(inside.withColumn("__cum", F.sum("__k").over(upto)), below, keys)
        .withColumn("__last", start + F.col("__cum") - 1)
        .withColumn("__first", F.col("__last") - F.col("__k") + 1)
        .withColumns(
            {"__r": (F.col("__n") - 1) * F.col("__p"), "__under": per_prob("__u"), "__over": per_prob("__o"), "__lo": start}
        )
    )

    def at(rank: Column) -> Column:
        """Value at a rank: inside the bracket, or the neighbour right below or above it."""
        exact = F.max(F.when(rank.between(F.col("__first"), F.col("__last")), F.col("__v")))
        under = F.max(F.when(rank == F.col("__lo") - 1, F.col("__under")))
        over = F.max(F.when(rank >= F.col("__lo"), F.col("__over")))
        beyond = F.max(rank) == F.max(F.col("__last")) + 1
        return F.coalesce(exact, under, F.when(beyond, over))

    picked = ranked.groupBy(*keys, "__i").agg(
        at(F.floor("__r")).alias("__a"), at(F.ceil("__r")).alias("__z"), F.max("__r").alias("__r")
    )
    value = F.when(
        F.col("__a").isNull() | F.col("__z").isNull(), F.raise_error(F.lit("quantile bracket missed its rank"))
    ).otherwise(F.col("__a") + (F.col("__z") - F.col("__a")) * (F.col("__r") - F.floor("__r")))
    picked = picked.withColumn("__x", value.cast("double"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__i") == i, F.col("__x"))).alias(name) for i, name in enumerate(probs)]
    )


def value_slices(df: DataFrame, keys: list[str] | str, col: str, slices: int = 64, descending: bool = False) -> DataFrame:
    """Add ``__vs``: an even slice number along ``col``, for laying a key out by value.

    The cut points come from a bounded sketch and are settled, so every task sees the same cuts.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    cuts = df.groupBy(*keys).agg(
        F.percentile_approx(F.col(col).cast("double"), [i / slices for i in range(1, slices)], 1000).alias("__cuts")
    )
    out = attach(df, cuts, keys)
    n = F.size(F.filter("__cuts", lambda c: c < F.col(col)))
    return out.withColumn("__vs", (-n if descending else n).cast("long")).drop("__cuts")
