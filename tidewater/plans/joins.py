"""Joins Spark has no operator for: as-of and interval joins, both safe for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.plans.timeline import lay_out, time_slice


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str] | str,
    ts: str,
    values: list[str],
    slice_seconds: int = 30 * 86400,
) -> DataFrame:
    """Latest right row at or before each left row, per key.

    Both sides are stacked and the last right row is carried forward, so the work is two
    exchanges whatever the ratio of the sides, and one hot key still runs in many tasks.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    packed = F.struct(*[F.col(v) for v in values])
    l = left.withColumns({"__right": F.lit(1), "__val": F.lit(None)})
    r = right.select(*keys, ts, F.lit(0).alias("__right"), packed.alias("__val"))
    l = l.withColumn("__val", F.lit(None).cast(r.schema["__val"].dataType))
    both = l.unionByName(r, allowMissingColumns=True)
    tl = lay_out(both, keys, [ts, "__right"], time_slice(ts, slice_seconds))
    out = tl.running(__seen=("last", "__val")).rows().where("__right = 1")
    return out.withColumns({v: F.col(f"__seen.{v}") for v in values}).drop("__right", "__val", "__seen")


def interval_join(
    entries: DataFrame,
    points: DataFrame,
    key: str,
    start: str,
    ts: str,
    seconds: int,
) -> DataFrame:
    """Pair each entry with the points of its key in ``(start, start + seconds]``.

    The equi-join key is ``(key, time bucket)`` with buckets as wide as the interval: an entry
    goes to two buckets, a point to one, and a hot key is spread over its buckets. ``points``
    keeps its own columns except ``key``.
    """
    b = F.floor(F.unix_seconds(F.col(start)) / seconds)
    e = entries.withColumn("__b", F.explode(F.array(b, b + 1)))
    p = points.withColumnRenamed(key, "__k").withColumn("__b", F.floor(F.unix_seconds(F.col(ts)) / seconds))
    cond = (
        (F.col(key) == F.col("__k"))
        & (e["__b"] == p["__b"])
        & (F.col(ts) > F.col(start))
        & (F.unix_micros(F.col(ts)) <= F.unix_micros(F.col(start)) + seconds * 1_000_000)
    )
    return e.join(p, cond).drop("__b", "__k")
