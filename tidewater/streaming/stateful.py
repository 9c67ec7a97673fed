"""Keyed state on streams in event-time order: bounded history, incremental indicators, positions, running metrics.

Rows wait in the state of their key until the key's own watermark (its newest timestamp less the delay) has passed them and
are then taken in order, so the answers do not depend on how rows arrive within the delay. A row that comes after its
place has been passed is late: it changes nothing and is handed on marked as late, to be counted or kept elsewhere.
State is a handful of numbers (or the last N bars) per key, and the rows of one delay.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.operators.setops import last_rows
from tidewater.streaming import streams

_NEVER = -(1 << 62)


def in_event_order(rows: DataFrame, key: str, values: list[str], delay_seconds: int, step: Callable, first: tuple, out: str, state: str, initial: DataFrame | None = None) -> DataFrame:
    """key, ts, late and the columns ``out`` for every row, in event-time order per key.

    ``step(state, rows)`` gets the state and the values of all rows of one timestamp (numbers, NULL as NaN) and returns the new
    state and one tuple of ``out`` per row of its answer. ``first`` is the state before any row. ``initial`` (key, ts, state
    columns) is the state after history up to ts: live rows up to it are late.
    """
    names = [c.strip().split(" ")[0] for c in out.split(",")]
    own = [c.strip().split(" ")[0] for c in state.split(",")]
    kind = rows.schema[key].dataType.simpleString()
    source = rows.select(key, "ts", *values)
    if initial is not None:  # one row per key, settled by the caller: the join sees its true size
        given = initial.select(F.col(key).alias("__k"), F.unix_micros("ts").alias("__until"), F.to_json(F.struct(*own)).alias("__given"))
        source = source.join(given, F.col(key) == F.col("__k"), "left").drop("__k")
    doubles = [f.name for f in T.StructType.fromDDL(out) if f.dataType == T.DoubleType()]
    warm = initial is not None
    delay = delay_seconds * 1_000_000

    def run(k, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        if held.exists:
            seen, done, waiting_at, waiting, *now = held.get
            now = tuple(now)
        else:
            seen, done, waiting_at, waiting, now = _NEVER, _NEVER, [], [], first
            if warm and pd.notna(pdf["__until"].iloc[0]):
                done = int(pdf["__until"].iloc[0])
                read = json.loads(pdf["__given"].iloc[0])
                now = tuple(read.get(c) for c in own)
        at = pdf["ts"].to_numpy("datetime64[us]").astype(np.int64)
        data = pdf[values].to_numpy(float) if values else np.zeros((len(pdf), 0))
        late = at <= done
        answers = [(k[0], x, True, *([None] * len(names))) for x in at[late]]
        at = np.concatenate((np.array(waiting_at, np.int64), at[~late]))
        data = np.concatenate((np.array(waiting, float).reshape(len(waiting_at), len(values)), data[~late]))
        seen = max(seen, int(at.max(initial=_NEVER)))
        order = np.argsort(at, kind="stable")
        at, data = at[order], data[order]
        ready = int(np.searchsorted(at, seen - delay, "right"))
        edges = np.flatnonzero(np.diff(at[:ready], prepend=_NEVER - 1, append=_NEVER - 1))
        for i, j in zip(edges[:-1], edges[1:]):
            now, said = step(now, data[i:j])
            answers += [(k[0], at[i], False, *x) for x in said]
            done = int(at[i])
        held.update((seen, done, at[ready:].tolist(), data[ready:].ravel().tolist(), *now))
        if answers:
            frame = pd.DataFrame(answers, columns=[key, "ts", "late", *names])
            yield frame.assign(ts=pd.to_datetime(frame["ts"], unit="us")).astype(dict.fromkeys(doubles, "float64"))

    return source.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, ts timestamp, late boolean, {out}", f"seen long, done long, waiting_at array<long>, waiting array<double>, {state}", "append", GroupStateTimeout.NoTimeout)


def _bars_step(n: int):
    def step(state, rows):
        kept, said = list(state[0] or []), []
        for (close,) in rows:
            kept = (kept + [float(close)])[-n:]
            said.append((len(kept), sum(kept) / len(kept)))
        return (kept,), said

    return step


def last_bars(bars: DataFrame, n: int = 50, delay_seconds: int = 0, initial: DataFrame | None = None) -> DataFrame:
    """Mean close and count over the last ``n`` bars of each symbol, for every bar; late bars are marked."""
    return in_event_order(bars, "symbol", ["close"], delay_seconds, _bars_step(n), ([],), "held long, mean_close double", "kept array<double>", initial)


def last_bars_state(history: DataFrame, n: int = 50) -> DataFrame:
    """(symbol, ts, kept): the state of :func:`last_bars` after stored bars, for a warm start."""
    recent = last_rows(history.select("symbol", "ts", "close"), ["symbol"], "ts", n)
    return recent.groupBy("symbol").agg(F.max("ts").alias("ts"), F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("b")).select("symbol", "ts", F.col("b.close").alias("kept"))


def _average(prev, total, count, x, n, a):
    """Mean of the first n values, then the exponential update."""
    if count < n:
        return None
    return total / n if prev is None else a * x + (1 - a) * prev


def incremental_indicators(bars: DataFrame, rsi_n: int = 14, fast: int = 10, slow: int = 20, delay_seconds: int = 0) -> DataFrame:
    """Wilder RSI and two SMA-seeded EMAs, updated bar by bar.

    Equals the batch indicators; the volume passes through for later gates.
    """
    a_fast, a_slow = 2 / (fast + 1), 2 / (slow + 1)

    def step(state, rows):
        n, last, gains, losses, g, l, closes_f, closes_s, ef, es, pf, ps = state
        said = []
        for c, volume in rows.tolist():
            n += 1
            if last is not None:
                up, down = max(c - last, 0.0), max(last - c, 0.0)
                if n - 1 <= rsi_n:
                    gains, losses = gains + up, losses + down
                g = _average(g, gains, n - 1, up, rsi_n, 1 / rsi_n)
                l = _average(l, losses, n - 1, down, rsi_n, 1 / rsi_n)
            closes_f += c if n <= fast else 0.0
            closes_s += c if n <= slow else 0.0
            pf, ps = ef, es
            ef = _average(ef, closes_f, n, c, fast, a_fast)
            es = _average(es, closes_s, n, c, slow, a_slow)
            rsi = 50.0 if g is None else 100.0 if l == 0 else 100 - 100 / (1 + g / l)
            cross = None
            if ps is not None and pf <= ps and ef > es:
                cross = "buy"
            elif ps is not None and pf >= ps and ef < es:
                cross = "sell"
            said.append((c, volume, rsi, ef, es, cross))
            last = c
        return (n, last, gains, losses, g, l, closes_f, closes_s, ef, es, pf, ps), said

    return in_event_order(
        bars, "symbol", ["close", "volume"], delay_seconds, step, (0, None, 0.0, 0.0, None, None, 0.0, 0.0, None, None, None, None),
        "close double, volume double, rsi double, fast_ema double, slow_ema double, cross string",
        "n long, last double, gains double, losses double, g double, l double, cf double, cs double, ef double, es double, pf double, ps double")


def incremental_trend(bars: DataFrame, delay_seconds: int = 0, spans: tuple[int, int, int] = (12, 26, 9), n: int = 14) -> DataFrame:
    """MACD with signal and histogram, and the rolling directional index (+DI, -DI, ADX), bar by bar as in batch."""
    a, b, c = (2 / (x + 1) for x in spans)

    def step(state, rows):
        ef, es, sig, high, low, close, moves, dxs = state
        moves, dxs, said = list(moves), list(dxs), []
        for h, lo, x in rows.tolist():
            ef, es = (x, x) if ef is None else (a * x + (1 - a) * ef, b * x + (1 - b) * es)
            macd = ef - es
            sig = macd if sig is None else c * macd + (1 - c) * sig
            tr, up, down = h - lo, 0.0, 0.0
            if close is not None:
                tr = max(tr, abs(h - close), abs(lo - close))
                rise, fall = h - high, low - lo
                up = rise if rise > fall and rise > 0 else 0.0
                down = fall if fall > rise and fall > 0 else 0.0
            moves = (moves + [tr, up, down])[-3 * n:]
            plus = minus = adx = None
            if len(moves) == 3 * n:
                total = sum(moves[0::3])
                plus, minus = (100 * sum(moves[k::3]) / total if total else None for k in (1, 2))
                dx = 100 * abs(plus - minus) / (plus + minus) if total and plus + minus else float("nan")
                dxs = (dxs + [dx])[-n:]
                adx = sum(dxs) / n if len(dxs) == n and not np.isnan(dxs).any() else None
            high, low, close = h, lo, x
            said.append((macd, sig, macd - sig, plus, minus, adx))
        return (ef, es, sig, high, low, close, moves, dxs), said

    return in_event_order(
        bars, "symbol", ["high", "low", "close"], delay_seconds, step, (None, None, None, None, None, None, [], []),
        "macd double, macd_signal double, macd_histogram double, plus_di double, minus_di double, adx double",
        "ef double, es double, sig double, high double, low double, close double, moves array<double>, dxs array<double>")


def stream_signals(indicators: DataFrame, min_volume: float = 10.0) -> DataFrame:
    """Cross signals that pass the volume gate."""
    ok = F.col("volume") >= min_volume
    return indicators.withColumns({"volume_ok": ok, "signal": F.when(ok, F.col("cross"))})


def positions(signals: DataFrame, capital: float = 10_000.0, share: float = 0.1, max_drawdown: float = 0.2, delay_seconds: int = 0) -> DataFrame:
    """One position per symbol following buy / sell signals; emits trades, and an alert each time
    equity falls below the allowed drawdown."""

    def step(state, rows):
        cash, qty, entry, peak, trades, below = state
        said = []
        for close, wish in rows.tolist():
            kind = pnl = None
            if wish == 1 and qty == 0:
                qty, entry, kind = cash * share / close, close, "open"
                cash -= qty * close
            elif wish == -1 and qty > 0:
                cash, kind, pnl = cash + qty * close, "close", qty * (close - entry)
                qty, trades = 0.0, trades + 1
            equity = cash + qty * close
            peak = max(peak, equity)
            if kind:
                said.append((kind, close, pnl, equity, trades))
            under = equity < peak * (1 - max_drawdown)
            if under and not below:
                said.append(("alert", close, None, equity, trades))
            below = under
        return (float(cash), float(qty), float(entry), float(peak), int(trades), bool(below)), said

    wish = F.when(F.col("signal") == "buy", 1.0).when(F.col("signal") == "sell", -1.0).otherwise(0.0)
    events = in_event_order(
        signals.select("symbol", "ts", "close", wish.alias("wish")), "symbol", ["close", "wish"], delay_seconds, step, (capital, 0.0, 0.0, capital, 0, False),
        "event string, price double, pnl double, equity double, trades long", "cash double, qty double, entry double, peak double, trades long, below boolean")
    return events.where("NOT late").drop("late")


def chunked_backtest(spark: SparkSession, chunks: str, schema: T.StructType, root: str, max_drawdown: float = 0.2) -> DataFrame:
    """Backtest over time chunks (files in ``chunks``) that are there by now: signals, positions and equity events so far.

    What one chunk hands to the next, indicator values as well as cash and open positions, is the state under ``root``. A later
    call with more chunks, or after a stop, goes on from it; nothing is computed again and nothing is reset in between.
    """
    bars = streams.read_stream(spark, chunks, schema, files_per_batch=1_000_000)
    signals = stream_signals(incremental_indicators(bars)).select("symbol", "ts", "close", "signal")
    done = streams.run_once(signals, "signals", path=f"{root}/signals")
    again = streams.read_stream(spark, f"{root}/signals/data", done.schema, files_per_batch=1_000_000)
    return streams.run_once(positions(again, max_drawdown=max_drawdown), "positions", path=f"{root}/positions")


def running_metrics(trades: DataFrame, capital: float = 10_000.0, delay_seconds: int = 0) -> DataFrame:
    """Trades, win rate, profit, equity and deepest drawdown per symbol after every exit time (rows of one time count together)."""

    def step(state, rows):
        n, wins, pnl, peak, low = state
        n, wins, pnl = n + len(rows), wins + int((rows[:, 0] > 0).sum()), pnl + float(np.nansum(rows[:, 0]))
        equity = capital + pnl
        peak = max(peak, equity)
        low = min(low, equity / peak - 1)
        return (n, wins, pnl, peak, low), [(n, wins / n, pnl, equity, low)]

    out = in_event_order(trades, "symbol", ["pnl"], delay_seconds, step, (0, 0, 0.0, capital, 0.0),
                         "trades long, win_rate double, pnl double, equity double, max_drawdown double", "n long, wins long, total double, peak double, low double")
    return out.where("NOT late").drop("late")
