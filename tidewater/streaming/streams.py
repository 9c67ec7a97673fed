"""Sources, event-time operators and sinks for live market data.

Every operator takes and returns a streaming DataFrame; windows close by watermark, so a replay
of landed files gives the same rows as the batch operators for all closed windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tidewater.functions.scalars import ratio
from tidewater.plans.timeline import time_slice
from tidewater.session import shared_folder

# Message kinds by the name that occurs in the stream field, most specific first.
MESSAGE_KINDS = ("bookTicker", "forceOrder", "markPrice", "fundingRate", "kline", "ticker", "depth", "trade")

#: Rows that a task holds at most while it gathers those of one key.
BUNDLED_ROWS = 1_000_000

#: Rows in one row of a join's state at most, and the length of a time slot in lengths of the interval.
PIECE, SLOT = 256, 4


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """Landed files as a stream; a Kafka source has the same shape after parsing."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def message_kind(stream: str | Column) -> Column:
    c = F.col(stream) if isinstance(stream, str) else stream
    out = None
    for kind in MESSAGE_KINDS:
        out = F.when(c.contains(kind), kind) if out is None else out.when(c.contains(kind), kind)
    return out.otherwise("unknown")


def route(messages: DataFrame, body: str = "body") -> DataFrame:
    """Add ``msg_type``; consumers filter on it."""
    return messages.withColumn("msg_type", message_kind(F.get_json_object(body, "$.stream")))


def dedupe(ticks: DataFrame, ids: list[str], delay: str = "1 hour") -> DataFrame:
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(ids)


def tumbling_bars(ticks: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    g = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width), "symbol").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.sum("amount").alias("volume"), F.count(F.lit(1)).alias("trades"))
    return g.withColumn("ts", F.col("window.start")).drop("window")


def sliding_state(ticks: DataFrame, width: str = "24 hours", step: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rolling market state: last, high, low, volume, change over ``width`` every ``step``."""
    g = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width, step), "symbol").agg(
        F.max_by("price", "ts").alias("last"), F.min_by("price", "ts").alias("first"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.sum("amount").alias("volume"), F.count(F.lit(1)).alias("trades"))
    return g.select(F.col("window.end").alias("ts"), "symbol", "last", "high", "low", "volume", "trades", (ratio("last", "first") - 1).alias("change"))


def sessions(ticks: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of activity separated by silence."""
    g = ticks.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("amount").alias("volume"))
    return g.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "trades", "volume")


def late_arrivals(messages: DataFrame, max_latency_seconds: float = 1.0, arrived: str | None = None) -> DataFrame:
    """Rows whose arrival (the column ``arrived``, else the processing time) is too far behind their event time."""
    came = F.current_timestamp() if arrived is None else F.col(arrived)
    lag = F.unix_micros(came) / 1e6 - F.unix_micros("ts") / 1e6
    return messages.withColumn("latency_seconds", lag).where(F.col("latency_seconds") > max_latency_seconds)


def bundled(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The rows of a micro-batch per ``keys`` in the order of ``by``: one row for at most PIECE of them, with a list of every other column."""
    lists = [f for f in rows.schema.fields if f.name not in keys]
    schema = StructType([rows.schema[k] for k in keys] + [StructField(f.name, ArrayType(f.dataType)) for f in lists])

    def gathered(held):
        t = pa.Table.from_batches(held)
        t = t.take(pc.sort_indices(t[by])).combine_chunks()
        groups = t.select(keys).append_column("__row", pa.array(np.arange(len(t)))).group_by(keys, use_threads=False).aggregate([("__row", "list")])
        rows_of = groups["__row_list"].combine_chunks()
        starts = rows_of.offsets.to_numpy()
        pieces = -(np.diff(starts) // -PIECE)
        owner = np.repeat(np.arange(len(groups)), pieces)
        cuts = starts[owner] + PIECE * (np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner])
        cuts, flat = pa.array(np.append(cuts, len(t)), pa.int32()), rows_of.flatten()
        columns = [pa.ListArray.from_arrays(cuts, t[f.name].combine_chunks().take(flat)) for f in lists]
        return pa.table([*(groups[k].take(pa.array(owner)) for k in keys), *columns], names=[*keys, *(f.name for f in lists)]).to_batches(max_chunksize=1000)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= BUNDLED_ROWS:
                yield from gathered(held)
                held, size = [], 0
        if held:
            yield from gathered(held)

    return rows.repartition(*keys).mapInArrow(run, schema)


def nearest_books(ticks: DataFrame, books: DataFrame, seconds: int = 5, delay: str = "1 hour") -> DataFrame:
    """Trades with the book snapshots of the ``seconds`` before them (stream-stream interval join).

    Both sides meet per symbol and time slot of SLOT times ``seconds``: a trade stands in its own slot, a book in those of
    the trades it can meet, so every pair is found once. What a micro-batch has of one symbol and slot is cut in the order
    of time into pieces, each a row of the state; the newest time of a piece is its event time. Only pieces whose times
    can meet are joined, and the exact distance is checked pair by pair: one joined row gives at most PIECE * PIECE pairs,
    so a task holds no more of them, however many trades a slot has. Joined rows are dealt out evenly before they become
    pairs, so a busy slot is not one task.
    """
    wide = SLOT * seconds
    span, slot_span = F.expr(f"interval {seconds} seconds"), F.expr(f"interval {wide} seconds")
    t = bundled(ticks.withColumn("__slot", time_slice("ts", wide)), ["symbol", "__slot"], "ts")
    t = t.withColumns({"__first": F.array_min("ts"), "__last": F.array_max("ts")}).withWatermark("__last", delay)
    b = books.withColumnsRenamed({"ts": "book_ts", "symbol": "book_symbol"})
    b = b.withColumn("__book_slot", F.explode(F.sequence(time_slice("book_ts", wide), time_slice(F.col("book_ts") + span, wide))))
    b = bundled(b, ["book_symbol", "__book_slot"], "book_ts")
    b = b.withColumns({"__book_first": F.array_min("book_ts"), "__book_last": F.array_max("book_ts")}).withWatermark("__book_last", delay)
    near = (F.col("symbol") == F.col("book_symbol")) & (F.col("__slot") == F.col("__book_slot")) & F.col("__last").between(
        F.col("__book_last") - slot_span, F.col("__book_last") + slot_span + span)
    meet = (F.col("__last") >= F.col("__book_first")) & (F.col("__first") <= F.col("__book_last") + span)
    of_tick, of_book = [c for c in ticks.columns if c != "symbol"], [c if c != "ts" else "book_ts" for c in books.columns if c != "symbol"]
    item = lambda names, i: [F.col(c)[F.col(i)].alias(c) for c in names]
    pieces = t.join(b, near & meet, "inner").repartition("symbol", "__first", "__book_first")
    pairs = pieces.select("symbol", *of_tick, *of_book, F.posexplode("ts").alias("__i", "__ts"))
    pairs = pairs.select("symbol", *item(of_tick, "__i"), *of_book)
    pairs = pairs.select("symbol", *of_tick, *of_book, F.posexplode("book_ts").alias("__j", "__book_ts"))
    pairs = pairs.where((F.unix_micros("ts") - F.unix_micros("__book_ts")).between(0, seconds * 1_000_000))
    return pairs.select(*ticks.columns, *item(of_book, "__j"))


def with_limits(stream: DataFrame, limits: DataFrame, key: str = "symbol") -> DataFrame:
    """Stream-static join against a dimension table (settle the table first so its size is known)."""
    return stream.join(limits, key, "left")


# -- sinks --------------------------------------------------------------------------------
def start(writer, spark: SparkSession):
    """Start a query. Its state gets ``spark.sql.shuffle.partitions`` partitions, for the life of the checkpoint."""
    return writer.start()


def run_once(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process everything available, write Parquet, return the written table.

    ``path`` holds the written rows and the checkpoint; a later call with the same path goes on where this one ended.
    """
    spark = stream.sparkSession
    root = path or f"{shared_folder(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
    writer = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{root}/data").option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
    )
    start(writer, spark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def run_batches(stream: DataFrame, name: str, handle: Callable[[DataFrame, int], None], mode: str = "append", interval: str | None = None, path: str | None = None):
    """Hand every micro-batch to ``handle``; ``interval`` throttles a long-running query, ``path`` names its checkpoint."""
    root = path or f"{shared_folder(stream.sparkSession)}/tidewater/{name}-{uuid.uuid4().hex}"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(handle)
    w = w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)
    q = start(w, stream.sparkSession)
    if interval is None:
        q.awaitTermination()
    return q


def fan_out(*consumers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One persisted batch for several consumers."""

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for consume in consumers:
                consume(batch, epoch)
        finally:
            batch.unpersist()

    return handle


class LatestTable:
    """Newest row per key, kept as versioned Parquet; a batch writes the next version.

    Versions are written beside each other. A batch builds on the newest complete version below its own number, found
    in the folder, so a batch that is run again or after a restart gives the same table.
    """

    def __init__(self, spark: SparkSession, key: list[str], ts: str, schema: StructType, keep: int = 1, path: str | None = None):
        self.spark, self.key, self.ts, self.schema, self.keep = spark, key, ts, schema, keep
        self.root = path or f"{shared_folder(spark)}/tidewater/latest-{uuid.uuid4().hex}"

    def versions(self) -> list[int]:
        """Numbers of the completely written versions, in order."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(root, "v*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName()[1:]) for f in done)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        from tidewater.operators.setops import last_rows

        both = batch.select(*self.schema.names)
        earlier = [v for v in self.versions() if v < epoch]
        if earlier:
            both = self._read(earlier[-1]).unionByName(both)
        if self.keep == 1:
            rest = [c for c in self.schema.names if c not in self.key]
            new = both.groupBy(*self.key).agg(F.max_by(F.struct(*rest), self.ts).alias("r")).select(*self.key, "r.*")
        else:
            new = last_rows(both.dropDuplicates([*self.key, self.ts]), self.key, self.ts, self.keep)
        new.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/v{epoch}")

    def _read(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{version}")

    def table(self) -> DataFrame:
        return self._read(self.versions()[-1])


class AppendTable:
    """Collect batches in one folder per batch number (idempotent on retry)."""

    def __init__(self, spark: SparkSession, schema: StructType, path: str | None = None):
        self.spark, self.schema = spark, schema
        self.root = path or f"{shared_folder(spark)}/tidewater/append-{uuid.uuid4().hex}"

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        batch.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/batch={epoch}")

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.root).select(*self.schema.names)
