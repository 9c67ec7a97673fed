"""Runs of consecutive rows of a key, found with one layout.

Every slice of a key reduces its rows to runs. Only its first and its last run can go on in another slice, so these two
per slice are joined up in a window over slices; all other runs are final where they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.plans.timeline import lay_out


def runs(df: DataFrame, key: str, order: list[str], slice_by: Column, item: Column, breaks: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, first, last, n): the items of the first and the last row of every run, and its length.

    ``item`` is a struct per row, ``breaks(previous, current)`` says whether a row starts a new run after the row before;
    NULL counts as no break.
    """
    tl = lay_out(df.withColumn("__item", item).select(key, *order, "__item"), key, order, slice_by)
    cut = tl.part[-1]
    tl = tl.add(__prev=tl.lag("__item"))
    tl = tl.add(__new=F.coalesce(breaks(F.col("__prev"), F.col("__item")) & F.col("__prev").isNotNull(), F.lit(False)).cast("int"))
    rows = tl.add(__run=F.sum("__new").over(tl.window(None, 0))).df
    place = F.struct(*order)
    local = rows.groupBy(key, cut, "__run").agg(F.min_by("__item", place).alias("first"), F.max_by("__item", place).alias("last"), F.count(F.lit(1)).alias("n"))
    local = local.withColumn("__top", F.max("__run").over(Window.partitionBy(key, cut)))
    inner = local.where("__run > 0 AND __run < __top").select(key, "first", "last", "n")
    w = Window.partitionBy(key).orderBy(cut, "__run")
    edge = local.where("__run = 0 OR __run = __top").withColumn("__before", F.lag("last").over(w))
    new = F.when(F.col("__run") > 0, F.lit(True)).otherwise(F.coalesce(breaks(F.col("__before"), F.col("first")), F.lit(False)))
    joined = edge.withColumn("__joined", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(cut, "__run")
    outer = joined.groupBy(key, "__joined").agg(F.min_by("first", at).alias("first"), F.max_by("last", at).alias("last"), F.sum("n").alias("n"))
    return inner.unionByName(outer.drop("__joined"))
