"""From entries to closed trades: first-touch exits, trailing stops, overlap rules, portfolio replay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewater.functions.scalars import ratio
from tidewater.plans.attach import attach
from tidewater.plans.firsttouch import first_met
from tidewater.plans.timeline import join_keys, lay_out, time_slice
from tidewater.session import settle


# -- exits --------------------------------------------------------------------------------
_DAY = 86_400_000_000


def _asked(entries: DataFrame, horizon_seconds: int, keep: list[str], fa: Column, fb: Column, trail: Column | int = 0) -> DataFrame:
    """Entries as searches: behind their own bar, up to the end of the horizon; ``keep`` rides along."""
    at = F.unix_micros("entry_ts")
    return entries.where(F.col("symbol").isNotNull() & F.col("entry_ts").isNotNull()).select(
        "symbol", at.alias("at"), (at + horizon_seconds * 1_000_000).alias("until"), fa.alias("fa"), fb.alias("fb"),
        (trail if isinstance(trail, Column) else F.lit(trail)).alias("trail"), F.struct(*dict.fromkeys(keep)).alias("e"))


def _steps(bars: DataFrame, a: Column, b: Column, **tops: Column) -> DataFrame:
    return bars.where("symbol IS NOT NULL AND ts IS NOT NULL").select(
        "symbol", F.unix_micros("ts").alias("at"), a.alias("a"), b.alias("b"), F.struct("ts", "high", "low", "close").alias("bar"), *[c.alias(n) for n, c in tops.items()])


def _closed(met: DataFrame, ids: list[str], stopped: Column, reached: Column, price: Column | None = None) -> DataFrame:
    """Exit of every search: the bar it met within its horizon, else the last bar before the end of the horizon.

    ``stopped``, ``reached`` and ``price`` see the columns of e and bar. Entries without a later bar in the horizon are left out.
    """
    within = F.col("met_at") <= F.col("until")
    x = met.select(within.alias("within"), "e.*", "bar.*", "seen")
    why = F.when(F.col("within"), F.when(F.coalesce(stopped, F.lit(False)), "stop").when(F.coalesce(reached, F.lit(False)), "target"))
    x = x.where("within OR seen IS NOT NULL").withColumn("__why", why)
    px = F.col("close") if price is None else price
    return x.select(
        *ids, F.when(F.col("within"), F.col("ts")).otherwise(F.col("seen.ts")).alias("exit_ts"),
        F.when(F.col("within"), px).otherwise(F.col("seen.close")).alias("exit_price"), F.coalesce("__why", F.lit("horizon")).alias("reason"))


def exits(
    entries: DataFrame,
    bars: DataFrame,
    horizon_seconds: int,
    ids: list[str],
    intrabar: bool = False,
    at_level: bool = False,
) -> DataFrame:
    """First later bar that touches stop or target, per entry.

    ``entries`` carry symbol, entry_ts, side (long/short), stop and target. The exit price is the
    close of the touching bar or, with ``at_level``, the level itself. The bar comes from trees of
    block minima and maxima (:mod:`tidewater.plans.firsttouch`), so no entry is joined to the bars of
    its horizon; entries that touch nothing close at the last bar within it.
    """
    long = F.col("side") == "long"
    below, above = F.when(long, F.col("stop")).otherwise(F.col("target")), F.when(long, F.col("target")).otherwise(F.col("stop"))
    low, high = ("low", "high") if intrabar else ("close", "close")
    met = first_met(_asked(entries, horizon_seconds, [*ids, "side", "stop", "target"], below, -above), _steps(bars, F.col(low), -F.col(high)), "symbol", 30 * _DAY)
    stopped = F.when(long, F.col(low) <= F.col("stop")).otherwise(F.col(high) >= F.col("stop"))
    reached = F.when(long, F.col(high) >= F.col("target")).otherwise(F.col(low) <= F.col("target"))
    level = F.when(F.col("__why") == "stop", F.col("stop")).when(F.col("__why") == "target", F.col("target")).otherwise(F.col("close"))
    return _closed(met, ids, stopped, reached, level if at_level else None)


def trailing_exits(
    entries: DataFrame, bars: DataFrame, horizon_seconds: int, ids: list[str], distance: float | None = None, atr_multiple: float | None = None
) -> DataFrame:
    """Ratcheting stop: best of the initial stop and ``close·(1 ∓ distance)`` (or ``close ∓ k·ATR``) so far.

    The stop in force at a bar comes from the bars before it: a search whose bound rises with the
    bars it passes. ATR rides on the bars as ``atr``.
    """
    long = F.col("side") == "long"
    gap = F.col("close") * distance if distance is not None else F.col("atr") * atr_multiple
    steps = _steps(bars, F.col("close"), -F.col("close"), top_a=F.col("close") - gap, top_b=-(F.col("close") + gap))
    asked = _asked(entries, horizon_seconds, ids, F.when(long, F.col("stop")), F.when(~long, -F.col("stop")), F.when(long, 1).otherwise(2))
    return _closed(first_met(asked, steps, "symbol", 30 * _DAY), ids, F.lit(True), F.lit(False))


@F.pandas_udf(DoubleType())
def _nearest_level(target: pd.Series, reach: pd.Series) -> pd.Series:
    """Smallest double whose distance below ``target`` is less than ``reach``, rounding included; the target itself where there is none."""
    t, r = target.to_numpy(float), reach.to_numpy(float)
    x = t - r
    for _ in range(4):
        x = np.where(t - np.nextafter(x, -np.inf) < r, np.nextafter(x, -np.inf), x)
    for _ in range(8):
        x = np.where((t - x < r) | (x >= t), x, np.nextafter(x, np.inf))
    return pd.Series(np.where(r > 0, x, t))


def break_even_exits(entries: DataFrame, bars: DataFrame, horizon_seconds: int, ids: list[str]) -> DataFrame:
    """Stop moves to the entry price once price came within half the initial risk of the target.

    Two searches: to the stop or the neighbourhood of the target, and from there to the moved stop or the target.
    """
    long = F.col("side") == "long"
    sign = F.when(long, 1.0).otherwise(-1.0)
    carried = [*ids, "side", "entry_price", "stop", "target"]
    near = sign * _nearest_level(sign * F.col("target"), 0.5 * F.abs(F.col("entry_price") - F.col("stop")))
    e = entries.withColumn("__near", near)
    steps = _steps(bars, F.col("close"), -F.col("close"))
    below, above = F.when(long, F.col("stop")).otherwise(F.col("__near")), F.when(long, F.col("__near")).otherwise(F.col("stop"))
    first = settle(first_met(_asked(e, horizon_seconds, carried, below, -above), steps, "symbol", 30 * _DAY), "near")
    close, stop, target = F.col("bar.close"), F.col("e.stop"), F.col("e.target")
    long = F.col("e.side") == "long"
    out = F.when(long, (close <= stop) | (close >= target)).otherwise((close >= stop) | (close <= target))
    on = (F.col("met_at") <= F.col("until")) & ~F.coalesce(out, F.lit(False))
    moved = F.when(long, F.greatest("e.entry_price", "e.stop")).otherwise(F.least("e.entry_price", "e.stop"))
    later = first.where(on).withColumn("__moved", moved)
    asked = later.select(
        "symbol", F.col("met_at").alias("at"), "until", F.when(long, F.col("__moved")).otherwise(target).alias("fa"), (-F.when(long, target).otherwise(F.col("__moved"))).alias("fb"),
        "trail", F.struct(*[F.col(f"e.{c}").alias(c) for c in dict.fromkeys(carried)], F.col("__moved").alias("moved"), F.col("bar").alias("near")).alias("e"))
    second = first_met(asked, steps, "symbol", 30 * _DAY).withColumn("seen", F.coalesce("seen", "e.near"))
    long, close = F.col("side") == "long", F.col("close")
    reached = F.when(long, close >= F.col("target")).otherwise(close <= F.col("target"))

    def closed(met, level):
        return _closed(met, ids, F.when(long, close <= F.col(level)).otherwise(close >= F.col(level)), reached)

    return closed(first.where(~on), "stop").unionByName(closed(second, "moved"))


def partial_targets(entries: DataFrame, bars: DataFrame, horizon_seconds: int, ids: list[str], levels: list[tuple[float, float]]) -> DataFrame:
    """Scale out at several profit levels ``(gain, share)``; one exit per level, PnL summed."""
    steps = F.array(*[F.struct(F.lit(g).alias("gain"), F.lit(s).alias("share")) for g, s in levels])
    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    e = entries.select("*", F.inline(steps)).withColumn("target", F.col("entry_price") * (1 + sign * F.col("gain")))
    keep = [*ids, "gain", "share", "entry_price", "side"]
    out = exits(e, bars, horizon_seconds, keep)
    pnl = F.when(F.col("side") == "long", 1.0).otherwise(-1.0) * (F.col("exit_price") - F.col("entry_price")) * F.col("share")
    return out.groupBy(*ids).agg(F.sum(pnl).alias("pnl"), F.count_if(F.col("reason") == "target").alias("levels_hit"))


# -- position arithmetic ------------------------------------------------------------------
def position_pnl(side: Column, entry: Column, price: Column, size: Column, leverage: Column | float = 1.0) -> Column:
    return F.when(side == "short", entry - price).otherwise(price - entry) * size * leverage


def mark_to_market(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Latest price per symbol onto open positions."""
    j = attach(positions, bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_price")), "symbol")
    return j.withColumns({
        "value": F.col("quantity") * F.col("last_price"),
        "unrealized_pnl": position_pnl(F.col("side"), F.col("entry_price"), F.col("last_price"), F.col("quantity"))})


def exposures(positions: DataFrame, equity: float) -> DataFrame:
    """Exposure per symbol and in total, with leverage."""
    e = F.sum(F.abs(F.col("quantity") * F.col("entry_price")))
    out = positions.rollup("symbol").agg(e.alias("exposure"))
    return out.withColumn("leverage", F.col("exposure") / equity)


def check_orders(orders: DataFrame, positions: DataFrame, limits: dict[str, float], equity: float) -> DataFrame:
    """Pre-trade limits in order: total exposure, leverage, symbol exposure; reason ``OK`` when accepted."""
    value = F.col("quantity") * F.col("entry_price")
    by_symbol = positions.groupBy("symbol").agg(F.sum(value).alias("symbol_exposure"))
    total = by_symbol.agg(F.sum("symbol_exposure").alias("t")).scalar()
    x = attach(orders, by_symbol, "symbol").withColumn("new_exposure", total + value)
    reason = (
        F.when(F.col("new_exposure") > limits["max_exposure"], "total exposure")
        .when(F.col("new_exposure") / equity > limits["max_leverage"], "leverage")
        .when(F.col("symbol_exposure") > limits["max_symbol_exposure"], "symbol exposure")
        .otherwise("OK"))
    return x.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "OK")


def daily_budget(trades: DataFrame, max_daily_loss: float, max_weekly_loss: float) -> DataFrame:
    """PnL per day with day and week budget flags."""
    day = trades.groupBy(F.date_trunc("day", "exit_time").alias("day")).agg(F.sum("pnl").alias("pnl"))
    week = day.groupBy(F.date_trunc("week", "day").alias("week")).agg(F.sum("pnl").alias("week_pnl"))
    out = day.withColumn("week", F.date_trunc("week", "day")).join(week, "week")
    return out.withColumns({"day_breached": F.col("pnl") < -max_daily_loss, "week_breached": F.col("week_pnl") < -max_weekly_loss})


def spaced_entries(trades_tl, seconds: int = 300):
    """Flag entries at least ``seconds`` after the previous entry (takes and returns a timeline)."""
    gap = F.unix_seconds("entry_time") - F.unix_seconds(trades_tl.lag("entry_time"))
    return trades_tl.add(spaced=F.coalesce(gap >= seconds, F.lit(True)))


# -- one position at a time ---------------------------------------------------------------
def non_overlapping(
    trades: DataFrame,
    key: str = "symbol",
    order: list[str] | None = None,
    slice_seconds: int = 86400,
    entry: str = "entry_time",
    exit: str = "exit_time",
) -> DataFrame:
    """Keep a trade only if the last kept trade of its key has closed by its entry.

    The rule is sequential, but a chunk of the timeline needs only one number from the past: the
    time until which the key is busy. Each chunk (bounded rows) is reduced to a step function
    *busy until on entering -> busy until on leaving*; chains started at different entries merge
    quickly, so it has few steps. One ordered pass over the steps gives every chunk its entering
    time, after which all chunks are resolved in parallel.
    """
    order = order or [entry, exit, "trade_id"]
    tl = lay_out(trades, key, order, time_slice(entry, slice_seconds), even=True)
    t = settle(
        tl.add(__in=F.unix_micros(entry), __out=F.unix_micros(exit), __at=tl.pos, __c=F.col(tl.part[-1])).rows(),
        "candidates",
    )
    slim = t.select(F.col(key).alias("__key"), "__c", "__at", "__in", "__out")
    steps = slim.groupBy("__key", "__c").applyInPandas(_chunk_steps, "__key string, __c long, since long, until long")
    busy = stream_in_order(steps, "__key", ["__c", "since"], _entering_times, "__key string, __c long, busy long")
    kept = (
        slim.join(settle(busy, "busy"), ["__key", "__c"])
        .groupBy("__key", "__c")
        .applyInPandas(_resolve_chunk, "__key string, __c long, __at long")
        .withColumnRenamed("__key", key)
    )
    return t.join(kept, [key, "__c", "__at"], "left_semi").drop("__in", "__out", "__at", "__c")


def stream_in_order(df: DataFrame, key: str, order: list[str], fn, schema: str) -> DataFrame:
    """Run ``fn(batches)`` over rows sorted by key and order; the sort spills, Python sees one batch at a time."""
    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fn, schema)


def _chunk_steps(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("__at")
    start, stop = pdf["__in"].to_numpy(), pdf["__out"].to_numpy()
    n = len(pdf)
    follow = np.maximum(np.searchsorted(start, stop, side="left"), np.arange(n) + 1).tolist()
    end = stop.tolist()
    for i in range(n - 1, -1, -1):
        if follow[i] < n:
            end[i] = end[follow[i]]
    first = np.r_[True, start[1:] != start[:-1]]  # a chain begins at the first row of an entry time
    start, end = start[first], np.array(end)[first]
    last = np.r_[end[1:] != end[:-1], True]
    return pd.DataFrame({"__key": pdf["__key"].iloc[0], "__c": pdf["__c"].iloc[0], "since": start[last], "until": end[last]})


def _entering_times(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per chunk the busy time on entering; a chunk is left through its first step at or after that time."""
    key = chunk = None
    busy = leaving = np.iinfo(np.int64).min
    for pdf in batches:
        out = []
        for k, c, since, until in zip(pdf["__key"], pdf["__c"], pdf["since"], pdf["until"]):
            if k != key:
                key, chunk, leaving = k, None, np.iinfo(np.int64).min
            if c != chunk:
                chunk, busy, taken = c, leaving, False
                out.append((k, c, busy))
            if not taken and since >= busy:
                leaving, taken = max(leaving, until), True
        yield pd.DataFrame(out, columns=["__key", "__c", "busy"])


def _resolve_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("__at")
    start, stop, busy = pdf["__in"].to_numpy(), pdf["__out"].to_numpy(), pdf["busy"].iloc[0]
    keep, i = [], int(np.searchsorted(start, busy, side="left"))
    while i < len(pdf):
        keep.append(i)
        i = max(i + 1, int(np.searchsorted(start, stop[i], side="left")))
    return pdf.iloc[keep][["__key", "__c", "__at"]]


# -- at most so many positions at a time --------------------------------------------------
_TAKEN = (1 << 63) - 1  # for chunks whose rows are all taken by earlier lanes: nothing is left to take


def at_most(
    trades: DataFrame,
    most: int,
    key: str = "symbol",
    order: list[str] | None = None,
    slice_seconds: int = 86400,
    entry: str = "entry_time",
    exit: str = "exit_time",
) -> DataFrame:
    """Keep a trade only if fewer than ``most`` kept trades of its key are open at its entry.

    Which of the free places a trade gets makes no difference, so let it be the first: the first place (lane) then takes
    what :func:`non_overlapping` keeps of all trades, the second what it keeps of the rest, and so on. Every lane is one
    such pass, ``most`` in all however long the trades stay open; a chunk replays the lanes before from the busy times it
    entered with, so the rest is never written. A NULL entry or exit is never kept.
    """
    order = order or [entry, exit, "trade_id"]
    tl = lay_out(trades.where(F.col(entry).isNotNull() & F.col(exit).isNotNull()), key, order, time_slice(entry, slice_seconds), even=True)
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # NULL is a key of its own
    t = settle(tl.add(__in=F.unix_micros(entry), __out=F.unix_micros(exit), __at=tl.pos, __c=F.col(tl.part[-1]), __key=name).rows(), "candidates")
    slim = t.select("__key", "__c", "__at", "__in", "__out")
    known = slim.select("__key", "__c").distinct().withColumn("lanes", F.array().cast("array<long>"))
    for _ in range(most):
        known = settle(known, "lanes")
        steps = join_keys(slim, known, ["__key", "__c"]).groupBy("__key", "__c").applyInPandas(_lane_steps, "__key string, __c long, since long, until long")
        busy = stream_in_order(steps, "__key", ["__c", "since"], _entering_times, "__key string, __c long, busy long")
        busy = join_keys(known, busy, ["__key", "__c"], "left")
        known = busy.select("__key", "__c", F.concat("lanes", F.array(F.coalesce("busy", F.lit(_TAKEN)))).alias("lanes"))
    kept = join_keys(slim, settle(known, "lanes"), ["__key", "__c"]).groupBy("__key", "__c").applyInPandas(_lane_rows, "__key string, __c long, __at long")
    return t.join(kept, ["__key", "__c", "__at"], "left_semi").drop("__in", "__out", "__at", "__c", "__key")


def _chain(start: np.ndarray, stop: np.ndarray, busy: int) -> np.ndarray:
    """Rows one place takes that is busy until ``busy``."""
    taken, i = np.zeros(len(start), bool), int(np.searchsorted(start, busy, side="left"))
    while i < len(start):
        taken[i] = True
        i = max(i + 1, int(np.searchsorted(start, stop[i], side="left")))
    return taken


def _lanes(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """(rows of a chunk in order, which of them the lanes known so far take)."""
    pdf = pdf.sort_values("__at")
    start, stop, left = pdf["__in"].to_numpy(), pdf["__out"].to_numpy(), np.arange(len(pdf))
    for busy in pdf["lanes"].iloc[0]:
        left = left[~_chain(start[left], stop[left], busy)]
    taken = np.ones(len(pdf), bool)
    taken[left] = False
    return pdf, taken


def _lane_steps(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, taken = _lanes(pdf)
    if taken.all():
        return pd.DataFrame({"__key": np.empty(0, object), "__c": np.empty(0, np.int64), "since": np.empty(0, np.int64), "until": np.empty(0, np.int64)})
    return _chunk_steps(pdf.iloc[np.flatnonzero(~taken)])


def _lane_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, taken = _lanes(pdf)
    at = pdf["__at"].to_numpy()[taken]
    return pd.DataFrame({"__key": np.full(len(at), str(pdf["__key"].iloc[0]), object), "__c": pdf["__c"].to_numpy()[:1].repeat(len(at)), "__at": at})


# -- portfolio replay ---------------------------------------------------------------------
def replay_single(
    candidates: DataFrame, capital: float = 10_000.0, position_share: float = 0.1, commission: float = 0.001, slippage: float = 0.0005
) -> DataFrame:
    """Runs that hold one position at a time, without any per-run loop.

    The trades that fit come from :func:`non_overlapping`. Each then changes cash by a factor
    that depends on that trade alone, so cash is a running product, and a run of any length is
    spread over its chunks.
    """
    order = ["entry_ts", "exit_ts", "trade_id"]
    kept = non_overlapping(candidates, "run_id", order, entry="entry_ts", exit="exit_ts")
    growth = F.col("exit_price") / F.col("entry_price")
    sign = F.when(F.col("side") == "short", -1.0).otherwise(1.0)
    per_value = sign * (growth - 1) - (1 + growth) * (commission + slippage)
    kept = settle(kept.withColumns({"__r": per_value, "__g": growth}), "kept")
    tl = lay_out(kept, "run_id", order, time_slice("entry_ts", 86400))
    factor = 1 + position_share * F.col("__r")
    rows = tl.running(__after=("product", factor), __before=("product<", factor)).rows()
    after = F.lit(capital) * F.col("__after")
    value = F.lit(capital) * F.coalesce("__before", F.lit(1.0)) * position_share
    return rows.withColumns({
        "quantity": value / F.col("entry_price"), "commission": value * (1 + F.col("__g")) * commission,
        "slippage": value * (1 + F.col("__g")) * slippage, "pnl": value * F.col("__r"), "cash_after": after}).drop("__r", "__g", "__after", "__before")


def replay(
    candidates: DataFrame,
    capital: float = 10_000.0,
    position_share: float = 0.1,
    max_positions: int = 5,
    commission: float = 0.001,
    slippage: float = 0.0005,
    one_per_symbol: bool = True,
) -> DataFrame:
    """Accepted trades of runs whose positions share cash, with sizes and costs, in time order.

    Exits do not depend on the portfolio, so they are found in parallel beforehand; what is left
    to do in order is cash and the position limit. That state is a handful of numbers, so each
    run is one ordered pass over its candidates in batches and never held as a whole.
    ``candidates``: run_id, trade_id, symbol, side, entry_ts, exit_ts, entry_price, exit_price.
    """
    schema = (
        "run_id string, trade_id long, symbol string, side string, entry_ts timestamp, exit_ts timestamp, "
        "entry_price double, exit_price double, quantity double, commission double, slippage double, pnl double, cash_after double"
    )
    fee = commission + slippage

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run_id, cash, book = None, capital, []
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.run_id != run_id:
                    run_id, cash, book = r.run_id, capital, []
                for done in [p for p in book if p[0] <= r.entry_ts]:
                    book.remove(done)
                    cash += done[1]
                if len(book) >= max_positions or (one_per_symbol and any(p[2] == r.symbol for p in book)):
                    continue
                value = cash * position_share
                if value <= 0 or value * (1 + fee) > cash:
                    continue
                qty = value / r.entry_price
                cash -= value * (1 + fee)
                out_value = qty * r.exit_price
                gain = (out_value - value) * (-1.0 if r.side == "short" else 1.0)
                c, s = out_value * commission, out_value * slippage
                book.append((r.exit_ts, value + gain - c - s, r.symbol))
                out.append((*r[:8], qty, c + value * commission, s + value * slippage, gain - c - s - value * fee, cash))
            yield pd.DataFrame(out, columns=[f.strip().split(" ")[0] for f in schema.split(",")])

    cols = ["run_id", "trade_id", "symbol", "side", "entry_ts", "exit_ts", "entry_price", "exit_price"]
    return stream_in_order(candidates.select(*cols), "run_id", ["entry_ts", "exit_ts", "trade_id"], run, schema)


def replay_equity(accepted: DataFrame, capital: float) -> DataFrame:
    """Realised equity after each exit, as a running sum over the accepted trades."""
    tl = lay_out(accepted, "run_id", ["exit_ts", "entry_ts", "trade_id"], time_slice("exit_ts", 86400))
    return tl.running(__p=("sum", "pnl")).rows().select("run_id", "exit_ts", (F.lit(capital) + F.col("__p")).alias("equity"))


def replay_summary(accepted: DataFrame, capital: float) -> DataFrame:
    p = F.col("pnl")
    return accepted.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("trades"), F.avg((p > 0).cast("double")).alias("win_rate"), F.sum("pnl").alias("pnl"),
        (F.sum("pnl") / capital * 100).alias("return_pct"), ratio(F.sum(F.when(p > 0, p)), F.abs(F.sum(F.when(p < 0, p)))).alias("profit_factor"))
