"""A bar store with versions: partition files that are never changed, and manifests that say which of them count.

    root/data/<id>/p_data_type=../p_symbol=../p_timeframe=../*.parquet     staged by one change, then left alone
    root/manifests/<id>/*.parquet                                          one row per partition folder
    root/_log/<version>.json                                               which manifest a version has, and the schema

A change stages its files and its manifest first and then creates the log entry of the next version, which only one writer
can do: a reader sees all of a change or nothing, a failed job leaves files nobody refers to, and of two writers that
started from the same version the later one gets :class:`StoreConflict` (upserts and deletions then start again from the new version).
Partitions a change does not touch keep their files. Listing reads the manifest only.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.clean import dedupe
from tidewater.operators.setops import last_rows
from tidewater.operators.validate import in_range

PARTITIONS = ["data_type", "symbol", "timeframe"]
_ENTRY = "data_type string, symbol string, timeframe string, path string, rows long, first_ts timestamp, last_ts timestamp"


class StoreConflict(RuntimeError):
    """Another change was committed meanwhile."""


def _same(left: DataFrame, right: DataFrame, cols: list[str]):
    return reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[c]) for c in cols])


class BarStore:
    def __init__(self, spark: SparkSession, root: str, attempts: int = 5):
        self.spark, self.root, self.attempts = spark, root.rstrip("/"), attempts

    # -- versions -------------------------------------------------------------------------
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the last committed change; 0 for a new store."""
        path, fs = self._path("_log")
        if not fs.exists(path):
            return 0
        return max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(path) if s.getPath().getName()[0].isdigit()), default=0)

    def _log(self, version: int) -> tuple[str | None, T.StructType | None]:
        if version == 0:
            return None, None
        text = self.spark.read.text(f"{self.root}/_log/{version:020d}.json", wholetext=True).first()[0]
        entry = json.loads(text)
        return entry["manifest"], T.StructType.fromJson(entry["schema"])

    def _commit(self, base: int, manifest: DataFrame, schema: T.StructType) -> int:
        name = uuid.uuid4().hex
        manifest.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifests/{name}")
        path, fs = self._path(f"_log/{base + 1:020d}.json")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if fs.exists(path):
                raise StoreConflict(f"version {base + 1} exists") from e
            raise
        out.write(bytearray(json.dumps({"manifest": name, "schema": schema.jsonValue()}).encode()))
        out.close()
        return base + 1

    def datasets(self, version: int | None = None) -> DataFrame:
        """Stored partition folders with rows, first and last timestamp and path, from the manifest alone."""
        name, _ = self._log(self.version() if version is None else version)
        if name is None:
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(f"{self.root}/manifests/{name}")

    # -- changes --------------------------------------------------------------------------
    def _stage(self, df: DataFrame) -> DataFrame:
        """Writes partition folders; their manifest rows. Large partitions are written by several tasks, small ones together."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        copies = df.withColumns({f"p_{c}": F.col(c) for c in PARTITIONS}).hint("rebalance", *PARTITIONS)
        copies.write.mode("errorifexists").option("compression", "snappy").partitionBy(*[f"p_{c}" for c in PARTITIONS]).parquet(path)
        back = self.spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(path)
        name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        folder = F.regexp_replace(name, "/[^/]*$", "").alias("path")
        return back.groupBy(*PARTITIONS, folder).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))

    def _merged_schema(self, version: int, df: DataFrame) -> T.StructType:
        _, old = self._log(version)
        fields = list(old.fields) if old else []
        return T.StructType([*fields, *(f for f in df.schema.fields if f.name not in {x.name for x in fields})])

    def write(self, df: DataFrame, mode: str = "append") -> int:
        """Adds rows, or with ``mode`` "overwrite" replaces the partitions that ``df`` has; the new version."""
        staged = self._stage(df)
        for _ in range(self.attempts):
            base = self.version()
            kept = self.datasets(base)
            if mode == "overwrite":
                kept = kept.join(staged, _same(kept, staged, PARTITIONS), "left_anti")
            try:
                return self._commit(base, kept.unionByName(staged), self._merged_schema(base, df))
            except StoreConflict:
                continue
        raise StoreConflict(f"no commit in {self.attempts} attempts")

    def upsert(self, new: DataFrame, keep_last: int | None = None) -> int:
        """Stored rows plus ``new``: the newest copy of a timestamp wins, optionally only the last N stay per partition.

        Only the partitions of ``new`` are read and written.
        """
        for _ in range(self.attempts):
            base = self.version()
            entries = self.datasets(base)
            touched = new.select(*PARTITIONS).distinct()
            concerned = entries.join(touched, _same(entries, touched, PARTITIONS), "left_semi")
            both = new.withColumn("__seq", F.lit(1))
            old = self._rows(concerned, base)
            if old is not None:
                both = old.withColumn("__seq", F.lit(0)).unionByName(both, allowMissingColumns=True)
            merged = dedupe(both, [*PARTITIONS, "ts"], ["__seq"], keep="last").drop("__seq")
            merged = last_rows(merged, PARTITIONS, "ts", keep_last) if keep_last else merged
            staged = self._stage(merged)
            rest = entries.join(touched, _same(entries, touched, PARTITIONS), "left_anti")
            try:
                return self._commit(base, rest.unionByName(staged), self._merged_schema(base, new))
            except StoreConflict:
                continue
        raise StoreConflict(f"no commit in {self.attempts} attempts")

    def delete(self, symbol=None, timeframe=None, data_type=None) -> int:
        """Takes the matching partitions out of the store; no file is read or written but the manifest."""
        hit = F.lit(True)
        for name, value in (("symbol", symbol), ("timeframe", timeframe), ("data_type", data_type)):
            if value is not None:
                hit = hit & F.col(name).eqNullSafe(F.lit(value))
        for _ in range(self.attempts):
            base = self.version()
            if base == 0:
                return 0
            try:
                return self._commit(base, self.datasets(base).where(~hit), self._log(base)[1])
            except StoreConflict:
                continue
        raise StoreConflict(f"no commit in {self.attempts} attempts")

    # -- reading --------------------------------------------------------------------------
    def _rows(self, entries: DataFrame, version: int) -> DataFrame | None:
        """Rows of the given manifest rows (as many as there are partition folders); None without any."""
        paths = [r["path"] for r in entries.select("path").distinct().sort("path").collect()]
        _, schema = self._log(version)
        if schema is None:
            return None
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, symbol=None, timeframe=None, data_types=None, start=None, end=None, version: int | None = None) -> DataFrame:
        """Rows of a version; partitions and time ranges are pruned by the manifest, the range is pushed to the scan as well."""
        version = self.version() if version is None else version
        entries = self.datasets(version)
        if symbol is not None:
            entries = entries.where(F.col("symbol") == symbol)
        if timeframe is not None:
            entries = entries.where(F.col("timeframe") == timeframe)
        if data_types is not None:
            entries = entries.where(F.col("data_type").isin(*data_types))
        if start is not None:
            entries = entries.where(F.col("last_ts") >= F.lit(start).cast("timestamp"))
        if end is not None:
            entries = entries.where(F.col("first_ts") <= F.lit(end).cast("timestamp"))
        rows = self._rows(entries, version)
        if rows is None:
            raise ValueError(f"no version {version} of {self.root}")
        return in_range(rows, "ts", start, end)


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Export in any Spark format, with a one-row JSON description next to it."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(f"{path}/data")
    info = df.agg(F.count(F.lit(1)).alias("rows")).withColumns(
        {"columns": F.lit(",".join(df.columns)), "format": F.lit(fmt), "written_at": F.current_timestamp()}
    )
    info.write.mode("errorifexists").json(f"{path}/metadata")


def covering(manifest: DataFrame, symbol: str, timeframe: str, start: str, end: str) -> DataFrame:
    """Prepared datasets whose range contains the request."""
    return manifest.where(
        (F.col("symbol") == symbol)
        & (F.col("timeframe") == timeframe)
        & (F.col("start") <= F.lit(start).cast("timestamp"))
        & (F.col("end") >= F.lit(end).cast("timestamp"))
    )
