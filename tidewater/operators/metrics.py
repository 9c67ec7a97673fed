"""Performance and risk analytics as per-series aggregations.

Everything is a combinable aggregate per series; order-dependent parts (drawdowns, streaks,
cumulative curves) come from :mod:`tidewater.plans.timeline`. Zero denominators give NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalars import ratio
from tidewater.operators.setops import last_rows
from tidewater.plans.attach import attach, quantiles
from tidewater.plans import sliding
from tidewater.plans.runs import runs
from tidewater.plans.timeline import Timeline, join_keys, lay_out, time_slice
from tidewater.session import settle
from tidewater.sources.views import TRADE_ORDER

YEAR = 252
ROOT = math.sqrt(YEAR)


def series_timeline(df: DataFrame, back: int = 0, ahead: int = 0, key: str = "series_id") -> Timeline:
    return lay_out(df, key, ["ts"], time_slice("ts", 30 * 86400), back, ahead)


def trades_timeline(trades: DataFrame, back: int = 0, ahead: int = 0) -> Timeline:
    """Closed trades by symbol in exit order; many trades share a day, so a slice is one day."""
    return lay_out(trades, "symbol", list(TRADE_ORDER), time_slice("exit_time", 86400), back, ahead)


# -- curves -------------------------------------------------------------------------------
def equity_curve(returns: DataFrame, start: float = 10_000.0, damp: float = 1.0) -> DataFrame:
    tl = series_timeline(returns)
    tl = tl.running(__s=("product", 1 + F.lit(damp) * F.coalesce("ret", F.lit(0.0))))
    return tl.rows().select("series_id", "ts", (F.lit(start) * F.col("__s")).alias("equity"))


def cumulative_pnl(trades: DataFrame) -> DataFrame:
    return trades_timeline(trades).running(cum_pnl=("sum", "pnl")).rows()


def drawdowns(returns: DataFrame) -> DataFrame:
    """Compounded value, running peak and drawdown of a return series."""
    tl = series_timeline(returns.where(F.col("ret").isNotNull()))
    cum = settle(tl.running(cum=("product", 1 + F.col("ret"))).rows(), "cumulative")
    return with_peak(cum, "cum")


def with_peak(curve: DataFrame, col: str) -> DataFrame:
    out = series_timeline(curve).running(peak=("max", col)).rows()
    return out.withColumn("dd", ratio(F.col(col) - F.col("peak"), F.col("peak")))


def drawdown_runs(dd: DataFrame) -> DataFrame:
    """Number the runs: every row at the peak starts a new run."""
    return series_timeline(dd).running(run=("sum", (F.col("dd") >= 0).cast("long"))).rows()


def drawdown_stats(dd: DataFrame) -> DataFrame:
    return dd.groupBy("series_id").agg(
        F.min("dd").alias("max_drawdown"), F.avg("dd").alias("avg_drawdown"),
        F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer_index"),
        F.sqrt(F.sum(F.col("dd") * F.col("dd"))).alias("root_square_sum"),
    )


def drawdown_duration(dd: DataFrame) -> DataFrame:
    """Mean length of drawdown runs in whole bars."""
    runs = drawdown_runs(dd).groupBy("series_id", "run").agg(F.count_if(F.col("dd") < 0).alias("n"))
    mean = F.avg(F.when(F.col("n") > 0, F.col("n")))
    return runs.groupBy("series_id").agg(F.coalesce(F.floor(mean), F.lit(0)).alias("mean_duration"))


def drawdown_periods(dd: DataFrame) -> DataFrame:
    """Closed drawdowns: start, recovery, days and depth; a still open one is left out."""
    runs = drawdown_runs(dd).groupBy("series_id", "run").agg(
        F.min(F.when(F.col("dd") < 0, F.col("ts"))).alias("start_date"),
        F.min(F.when(F.col("dd") >= 0, F.col("ts"))).alias("__peak_at"),
        F.min("dd").alias("max_drawdown"),
    )
    after = runs.select("series_id", (F.col("run") - 1).alias("run"), F.col("__peak_at").alias("end_date"))
    j = runs.where("start_date IS NOT NULL").join(after, ["series_id", "run"])
    days = F.floor((F.unix_seconds("end_date") - F.unix_seconds("start_date")) / 86400)
    return j.select("series_id", "start_date", "end_date", days.alias("duration_days"), "max_drawdown")


# -- return statistics --------------------------------------------------------------------
def total_return(r: str | Column = "ret") -> Column:
    """Compounded return; a return of -1 loses everything, one below -1 turns the sign."""
    return F.product(1 + (F.col(r) if isinstance(r, str) else r)) - 1


def annualised(total: Column, n: Column, periods: int = YEAR) -> Column:
    return F.pow(1 + total, F.lit(float(periods)) / n) - 1


def calendar_annualised(total: Column, first: Column, last: Column) -> Column:
    years = F.floor((F.unix_seconds(last) - F.unix_seconds(first)) / 86400) / F.lit(365.25)
    return F.when(years > 0, F.pow(1 + total, ratio(F.lit(1.0), years)) - 1).otherwise(F.lit(0.0))


def sharpe(r: Column, rf: float = 0.0, sample: bool = True) -> Column:
    sd = F.stddev(r) if sample else F.stddev_pop(r)
    return ratio(F.avg(r) - rf / YEAR, sd) * ROOT


def sortino(r: Column, rf: float = 0.0, downside: str = "rms_negative") -> Column:
    """``downside``: rms_negative, std_negative, pop_negative or rms_all (of ``min(x, 0)``)."""
    x = r - rf / YEAR
    neg = F.when(x < 0, x)
    spread = {
        "rms_negative": lambda: F.sqrt(F.avg(neg * neg)),
        "std_negative": lambda: F.stddev(neg),
        "pop_negative": lambda: F.stddev_pop(neg),
        "rms_all": lambda: F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2))),
    }[downside]()
    return ratio(F.avg(x), spread) * ROOT


def omega(r: Column, threshold: float = 0.0) -> Column:
    x = r - threshold
    return ratio(F.sum(F.greatest(x, F.lit(0.0))), F.abs(F.sum(F.least(x, F.lit(0.0)))))


def skew_corrected(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis_corrected(x: str) -> Column:
    n = F.count(x).cast("double")
    g = (n + 1) * F.kurtosis(x) + 6
    return F.when(n > 3, g * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)))


def value_at_risk(returns: DataFrame, key: str = "series_id", levels: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """Historical VaR and the mean of the returns at or below it, per level."""
    named = {f"var_{int(round(c * 100))}": 1 - c for c in levels}
    q = settle(quantiles(returns, key, "ret", {n: round(p, 10) for n, p in named.items()}), "var")
    j = returns.join(q, key)
    tails = [F.avg(F.when(F.col("ret") <= F.col(n), F.col("ret"))).alias(n.replace("var", "cvar")) for n in named]
    return j.groupBy(key).agg(*[F.max(n).alias(n) for n in named], *tails)


# Standard normal quantiles and densities used by parametric VaR.
NORMAL = {0.95: (1.6448536269514722, 0.10313564037537128), 0.99: (2.3263478740408408, 0.026652142203457738)}


def parametric_var(returns: DataFrame, level: float = 0.95) -> DataFrame:
    z, density = NORMAL[level]
    mu, sd = F.avg("ret"), F.stddev("ret")
    return returns.groupBy("series_id").agg((mu - z * sd).alias("var"), (mu - sd * density / (1 - level)).alias("es"))


def return_ratios(returns: DataFrame, dd: DataFrame, rf: float = 0.02) -> DataFrame:
    """Calmar, Sterling, Burke, Martin, Pain, Kappa, Modigliani, upside potential and friends.

    ``annual_ref`` keeps the variant that adds 1 to the growth factor once more.
    """
    r = F.col("ret")
    x = r - rf / YEAR
    base = returns.where(r.isNotNull()).groupBy("series_id").agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), total_return().alias("total"),
        (ratio(F.avg(x), F.stddev_pop(x)) * ROOT).alias("excess_ratio"),
        ratio(F.avg(F.when(x > 0, x)), F.stddev_pop(F.when(x < 0, x))).alias("upside_potential"),
    )
    j = base.join(drawdown_stats(dd), "series_id")
    annual = annualised(F.col("total"), F.col("n"))
    ref = F.pow(F.col("total") + 2, F.lit(float(YEAR)) / F.col("n")) - 1
    depth = F.abs("max_drawdown")
    return j.withColumns(
        {
            "calmar_annual": ratio(annual, depth), "calmar_ref": ratio(ref, depth),
            "calmar_root": ratio(F.col("mean") * ROOT, depth), "calmar_mean": ratio(F.col("mean") * YEAR, depth),
            "calmar_total": ratio(F.col("total"), depth), "sterling": ratio(annual, depth),
            "burke": ratio(annual, F.col("root_square_sum")), "martin": ratio(annual, F.col("root_square_sum")),
            "pain": F.col("excess_ratio"), "kappa": F.col("excess_ratio"), "modigliani": F.col("excess_ratio"),
            "recovery": ratio(F.col("total"), depth),
        }
    )


def monthly_stats(returns: DataFrame, key: str, ts: str) -> DataFrame:
    months = returns.groupBy(key, F.date_trunc("month", ts).alias("month")).agg(total_return().alias("m"))
    return months.groupBy(key).agg(
        F.count(F.lit(1)).alias("months"), F.avg("m").alias("mean"), F.stddev("m").alias("std"), F.max("m").alias("best"),
        F.min("m").alias("worst"), F.avg((F.col("m") > 0).cast("double")).alias("positive_months"),
    )


def per_period(returns: DataFrame, units: tuple[str, ...] = ("day", "week", "month")) -> DataFrame:
    """Sharpe, Sortino, deepest drawdown and Calmar (annualised mean over drawdown) per calendar period.

    Ratios are plain aggregates. For the drawdown each day folds to a path, and the days of a period, 31 at most, are
    folded in order.
    """
    unit = F.explode(F.array(*[F.lit(u) for u in units])).alias("unit")
    keys = ["series_id", "unit", "period"]
    period = F.expr("date_trunc(unit, ts)").alias("period")
    x = returns.select("series_id", "ts", "ret", unit)
    stats = x.groupBy("series_id", "unit", period).agg(
        F.count("ret").alias("n"), sharpe(F.col("ret")).alias("sharpe"), sortino(F.col("ret")).alias("sortino"), F.avg("ret").alias("__mean"))
    known = returns.where("ret IS NOT NULL AND ts IS NOT NULL").select("series_id", "ts", "ret")
    tl = lay_out(known, "series_id", ["ts"], time_slice("ts", 86400))
    days = sliding.slice_paths(tl, "ret").select("series_id", F.timestamp_seconds(F.col(tl.part[-1]) * 86400).alias("ts"), "path", unit)
    falls = days.groupBy("series_id", "unit", period).agg(F.sort_array(F.collect_list(F.struct("ts", "path"))).alias("d"))
    falls = falls.select(*keys, sliding.folded_fall(F.col("d.path")).alias("max_drawdown"))
    out = join_keys(stats, falls, keys, "left")
    return out.withColumn("calmar", ratio(F.col("__mean") * YEAR, F.abs("max_drawdown"))).drop("__mean")


# -- trades -------------------------------------------------------------------------------
def trade_stats(trades: DataFrame, key: str = "symbol") -> DataFrame:
    p = F.col("pnl")
    win, loss = F.when(p > 0, p), F.when(p < 0, p)
    hours = (F.unix_seconds("exit_time") - F.unix_seconds("entry_time")) / 3600.0
    span = F.unix_seconds(F.max("exit_time")) - F.unix_seconds(F.min("entry_time"))
    return trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("trades"), F.count(win).alias("wins"), F.count(loss).alias("losses"),
        F.count_if(p == 0).alias("even"), (F.count(win) / F.count(F.lit(1))).alias("win_rate"), F.avg(p).alias("avg_trade"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.avg(F.when(p <= 0, p)), F.lit(0.0)).alias("avg_loss_incl_zero"),
        ratio(F.sum(win), F.abs(F.sum(loss))).alias("profit_factor"),
        ratio(F.avg(win), F.abs(F.avg(loss))).alias("risk_reward"),
        F.sum(p).alias("total_pnl"), F.avg("ret").alias("avg_return"),
        F.avg(hours).alias("avg_hours"), ratio(F.sum(hours) * 3600, span).alias("time_in_market"),
        (F.count(win) / F.count(F.lit(1)) * F.avg(win) - F.count(loss) / F.count(F.lit(1)) * F.abs(F.avg(loss))).alias("expectancy"),
    )


def _trade_runs(trades: DataFrame, item: Column, breaks) -> DataFrame:
    return runs(trades, "symbol", list(TRADE_ORDER), time_slice("exit_time", 86400), item, breaks)


def streaks(trades: DataFrame) -> DataFrame:
    """Longest runs of wins and of non-wins; a NULL result is a run of its own."""
    win = F.struct((F.col("pnl") > 0).alias("win"))
    found = _trade_runs(trades, win, lambda a, b: F.coalesce(a["win"] != b["win"], F.lit(True)))
    best = lambda w: F.coalesce(F.max(F.when(F.col("first.win") == w, F.col("n"))), F.lit(0))
    return found.groupBy("symbol").agg(best(True).alias("max_consecutive_wins"), best(False).alias("max_consecutive_losses"))


def back_to_back(trades: DataFrame, seconds: int = 3600) -> DataFrame:
    """Longest chain of trades that each start within ``seconds`` of the previous exit."""
    times = F.struct(F.unix_seconds("entry_time").alias("entry"), F.unix_seconds("exit_time").alias("exit"))
    chains = _trade_runs(trades, times, lambda a, b: F.coalesce(b["entry"] - a["exit"] >= seconds, F.lit(True)))
    return chains.groupBy("symbol").agg(F.max("n").alias("max_chain"))


def monthly_pnl(trades: DataFrame) -> DataFrame:
    """PnL, trades and win rate per symbol and month, empty months included."""
    m = F.date_trunc("month", "exit_time")
    agg = trades.groupBy("symbol", m.alias("month")).agg(
        F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))
    span = trades.groupBy("symbol").agg(F.min(m).alias("a"), F.max(m).alias("z"))
    grid = span.select("symbol", F.explode(F.sequence("a", "z", F.expr("interval 1 month"))).alias("month"))
    out = grid.join(agg, ["symbol", "month"], "left")
    return out.withColumns({"pnl": F.coalesce("pnl", F.lit(0.0)), "trades": F.coalesce("trades", F.lit(0))})


def trade_costs(trades: DataFrame, commission: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    notional = F.abs(F.col("entry_price") * F.col("quantity"))
    c, s = notional * commission, notional * slippage
    return trades.withColumns({"commission": c, "slippage": s, "net_pnl": F.col("pnl") - c - s})


# -- benchmark ----------------------------------------------------------------------------
def benchmark_stats(returns: DataFrame, bench: DataFrame, rf: float = 0.02) -> DataFrame:
    """Beta, alpha, tracking error, information ratio, correlation, relative performance, t statistic.

    The p-value uses the normal approximation of the t distribution.
    """
    j = returns.join(bench, "ts").where("ret IS NOT NULL AND bench IS NOT NULL")
    r, b = F.col("ret"), F.col("bench")
    d = r - b
    beta = ratio(F.covar_samp(r, b), F.var_samp(b))
    beta_pop = ratio(F.covar_samp(r, b), F.var_pop(b))
    daily = rf / YEAR
    n = F.count(r)
    pooled = (F.var_samp(r) + F.var_samp(b)) / 2
    t = ratio(F.avg(r) - F.avg(b), F.sqrt(pooled * 2 / n))
    out = j.groupBy("series_id").agg(
        n.alias("n"), beta.alias("beta"), ((F.avg(r) - daily - beta * (F.avg(b) - daily)) * YEAR).alias("alpha"),
        (F.stddev(d) * ROOT).alias("tracking_error"), ratio(F.avg(d) * YEAR, F.stddev(d) * ROOT).alias("information_ratio"),
        F.corr(r, b).alias("correlation"), (ratio(F.product(1 + r), F.product(1 + b)) - 1).alias("relative_performance"),
        t.alias("t_stat"), beta_pop.alias("beta_mixed"), (F.avg(r) - beta_pop * F.avg(b)).alias("alpha_mixed"),
        ratio(F.avg(r - daily), beta).alias("treynor_raw"), (F.avg(r) - daily - beta * (F.avg(b) - daily)).alias("jensen"),
    )
    return out.withColumns({"p_value": 2 * (1 - normal_cdf(F.abs("t_stat"))), "treynor": F.col("treynor_raw") * ROOT})


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution for ``z >= 0`` (Zelen and Severo approximation, error below 1e-7)."""
    k = 1 / (1 + 0.2316419 * z)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return 1 - F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


# -- reports ------------------------------------------------------------------------------
def risk_report(returns: DataFrame, trades: DataFrame, dd: DataFrame) -> DataFrame:
    """The 18-metric risk report, one row per series (trades carry the series in ``symbol``)."""
    r = F.col("ret")
    clean = returns.where(r.isNotNull())
    base = clean.groupBy("series_id").agg(
        F.avg("ret").alias("__mean"), sortino(r).alias("sortino_ratio"), omega(r).alias("omega_ratio"), sharpe(r).alias("sharpe_ratio"),
        (F.stddev(r) * ROOT).alias("volatility"), skew_corrected("ret").alias("skewness"), kurtosis_corrected("ret").alias("kurtosis"))
    p = F.col("pnl")
    t = trades.groupBy(F.col("symbol").alias("series_id")).agg(
        F.avg((p > 0).cast("double")).alias("win_rate"), F.sum(F.when(p > 0, p)).alias("__gross"),
        ratio(F.sum(F.when(p > 0, p)), F.abs(F.sum(F.when(p < 0, p)))).alias("profit_factor"),
        ratio(F.avg(F.when(p > 0, p)), F.abs(F.avg(F.when(p < 0, p)))).alias("risk_reward_ratio"))
    out = base.join(value_at_risk(clean, levels=(0.95,)), "series_id").join(drawdown_stats(dd), "series_id")
    out = out.join(drawdown_duration(dd), "series_id").join(t, "series_id", "left")
    depth = F.abs("max_drawdown")
    return out.withColumns(
        {
            "calmar_ratio": ratio(F.col("__mean") * ROOT, depth), "pain_index": F.col("avg_drawdown"),
            "recovery_factor": ratio(F.col("__gross"), depth), "drawdown_duration": F.col("mean_duration"),
        }
    ).drop("__mean", "__gross", "mean_duration", "root_square_sum")


def equity_report(equity: DataFrame) -> DataFrame:
    """Return, risk and ratio metrics straight from an equity curve."""
    tl = series_timeline(equity, back=1)
    r = settle(tl.add(ret=ratio(F.col("equity"), tl.lag("equity")) - 1).rows(), "equity_returns")
    depth = with_peak(equity, "equity").groupBy("series_id").agg(F.min("dd").alias("max_drawdown"))
    agg = r.groupBy("series_id").agg(
        F.min("ts").alias("a"), F.max("ts").alias("z"), (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("total_return"),
        sharpe(F.col("ret")).alias("sharpe_ratio"), sortino(F.col("ret"), downside="std_negative").alias("sortino_ratio"),
        omega(F.col("ret")).alias("omega_ratio"), (F.stddev("ret") * ROOT).alias("volatility"))
    out = agg.join(depth, "series_id")
    annual = calendar_annualised(F.col("total_return"), F.col("a"), F.col("z"))
    return out.withColumns({
        "annualized_return": annual, "calmar_ratio": ratio(annual, F.abs("max_drawdown")),
        "recovery_factor": ratio(F.col("total_return"), F.abs("max_drawdown"))}).drop("a", "z")


def rolling_robustness(returns: DataFrame, windows: tuple[int, ...] = (30, 60, 90, 180), rf: float = 0.02) -> DataFrame:
    """Mean over all full windows of Sharpe, Sortino, max drawdown and win rate, per window size.

    The drawdown inside a window comes from sliding folds (:mod:`tidewater.plans.sliding`), so no window is stored.
    """
    tl = series_timeline(returns.where(F.col("ret").isNotNull()), back=max(windows))
    x = F.col("ret") - rf / YEAR
    down = F.pow(F.least(x, F.lit(0.0)), 2)
    cols = {}
    for n in windows:
        w, full = tl.last(n), tl.pos >= n - 1
        cols |= {
            f"sharpe_{n}": F.when(full, ratio(F.avg(x).over(w), F.stddev_pop(x).over(w)) * ROOT),
            f"sortino_{n}": F.when(full, ratio(F.avg(x).over(w), F.sqrt(F.avg(down).over(w))) * ROOT),
            f"win_{n}": F.when(full, F.avg((F.col("ret") > 0).cast("double")).over(w)),
        }
    parts = [
        F.struct(F.lit(n).alias("window_bars"), F.avg(f"sharpe_{n}").alias("sharpe"), F.avg(f"sortino_{n}").alias("sortino"), F.avg(f"win_{n}").alias("win_rate"))
        for n in windows
    ]
    ratios = tl.add(**cols).rows().groupBy("series_id").agg(F.array(*parts).alias("w")).select("series_id", F.inline("w"))
    return join_keys(ratios, rolling_drawdowns(returns, windows), ["series_id", "window_bars"])


def rolling_drawdowns(returns: DataFrame, windows: tuple[int, ...] = (30, 60, 90, 180)) -> DataFrame:
    """Mean over all full windows of the deepest drawdown inside the window; NULL where no window is full."""
    tl = series_timeline(returns.where(F.col("ret").isNotNull()).select("series_id", "ts", "ret"), back=max(windows))
    falls = sliding.rolling_falls(tl, "ret", windows).groupBy("series_id", "window_bars").agg(F.sum("falls").alias("f"), F.sum("n").alias("n"))
    return falls.select("series_id", "window_bars", F.when(F.col("n") > 0, F.col("f") / F.col("n")).alias("max_drawdown"))


def path_drawdown(path: Column) -> Column:
    """Deepest drawdown of a short return path."""
    zero = F.struct(F.lit(1.0).alias("cum"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("low"))

    def step(s, r):
        cum = s["cum"] * (1 + r)
        peak = F.greatest(s["peak"], cum)
        return F.struct(cum.alias("cum"), peak.alias("peak"), F.least(s["low"], (cum - peak) / peak).alias("low"))

    return F.aggregate(path, zero, step, lambda s: s["low"])


# -- profiles -----------------------------------------------------------------------------
def correlation_pairs(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Upper-triangle correlations as (a, b, corr) rows, all pairs in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = df.groupBy(*keys).agg(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]).alias("p")
    )
    return wide.select(*keys, F.inline("p"))


def profile(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Count, missing, distinct, range, mean, deviation, exact quartiles, shape — per feature and key."""
    long = settle(df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([key], cols, "feature", "value"), "long")
    base = long.groupBy(key, "feature").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("count"), F.avg(F.col("value").isNull().cast("double")).alias("missing"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev("value").alias("std"),
        skew_corrected("value").alias("skew"), kurtosis_corrected("value").alias("kurtosis"))
    distinct = long.where("value IS NOT NULL").groupBy(key, "feature", "value").agg(F.lit(1).alias("one"))
    distinct = distinct.groupBy(key, "feature").agg(F.count(F.lit(1)).alias("distinct"))
    q = quantiles(long, [key, "feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return base.join(distinct, [key, "feature"], "left").join(q, [key, "feature"], "left")


def histogram(df: DataFrame, key: str, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per equal-width bin; the top edge belongs to the last bin, empty bins are 0."""
    x = df.where(F.col(col).between(lo, hi))
    b = F.least(F.floor((F.col(col) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return fill_bins(x.groupBy(key, b.alias("bin")).agg(F.count(F.lit(1)).alias("n")), df, key, 0, bins - 1)


def fill_bins(counts: DataFrame, df: DataFrame, key: str, first: int, last: int) -> DataFrame:
    grid = df.select(key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return grid.join(counts, [key, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def clock_counts(df: DataFrame, key: str, ts: str, unit: str) -> DataFrame:
    """Rows per hour of day (24) or weekday (7, Monday = 0), zeros included."""
    part, last = (F.hour(ts), 23) if unit == "hour" else ((F.dayofweek(ts) + 5) % 7, 6)
    return fill_bins(df.groupBy(key, part.alias("bin")).agg(F.count(F.lit(1)).alias("n")), df, key, 0, last)


# -- market state -------------------------------------------------------------------------
def day_state(bars: DataFrame, slice_seconds: int = 86400) -> DataFrame:
    """Trailing 24 h: last, volume, change, high, low at every bar, whatever the number of bars a day.

    A slice of time gets copies of the rows of the slices that reach into the 24 h before it, so the halo follows the
    clock and not a row count. NULL times are a slice of their own, each of whose rows sees all of them.
    """
    from pyspark.sql import Window

    sec, day = F.unix_seconds("ts"), 86400
    own = F.floor(sec / slice_seconds)
    ahead = F.floor((sec + day) / slice_seconds)
    x = bars.withColumns({"__sec": sec, "__own": own}).withColumn("__slice", F.explode(F.when(own.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(own, ahead))))
    w = Window.partitionBy("symbol", "__slice").orderBy("__sec").rangeBetween(-day, 0)
    first = F.first("close").over(w)
    x = x.withColumns({
        "last": F.col("close"), "volume_24h": F.sum("volume").over(w), "change_24h": ratio(F.col("close") - first, first),
        "high_24h": F.max("high").over(w), "low_24h": F.min("low").over(w)})
    return x.where(F.col("__slice").eqNullSafe(F.col("__own"))).drop("__sec", "__own", "__slice")


def liquidity(bars: DataFrame, n: int = 20) -> DataFrame:
    recent = last_rows(bars, "symbol", "ts", n).groupBy("symbol").agg(F.avg("volume").alias("avg_volume"))
    whole = bars.groupBy("symbol").agg(
        F.avg(ratio(F.abs(F.col("high") - F.col("low")), F.col("volume"))).alias("price_impact"),
        (F.avg(F.col("high") - F.col("low")) / F.max_by("close", "ts")).alias("bid_ask_spread"), F.max_by("volume", "ts").alias("__last"))
    return join_keys(whole, recent, ["symbol"]).withColumn("volume_ratio", F.col("__last") / F.col("avg_volume")).drop("__last")


def book_metrics(books: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    depth = lambda side: F.aggregate(side, zero, lambda a, x: a + x["qty"])
    bid, ask = F.col("bids")[0]["price"], F.col("asks")[0]["price"]
    d = books.withColumns({"mid": (bid + ask) / 2, "spread": ask - bid, "bid_depth": depth("bids"), "ask_depth": depth("asks")})
    return d.withColumn("imbalance", ratio(F.col("bid_depth") - F.col("ask_depth"), F.col("bid_depth") + F.col("ask_depth")))


def rollup_status(ticks: DataFrame, levels: tuple[str, ...] = ("exchange", "symbol")) -> DataFrame:
    """Data points and last update per level (exchange, symbol, timeframe, ...) and in total."""
    return ticks.rollup(*levels).agg(F.count(F.lit(1)).alias("points"), F.max("ts").alias("last_update"))


def top_movers(bars: DataFrame) -> DataFrame:
    """Change of every symbol over its whole period, and its rank (one row per symbol)."""
    change = bars.groupBy("symbol").agg((F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("change"))
    return change.withColumn("rank", F.rank().over(Window.orderBy(F.desc("change"))))


def market_snapshot(bars: DataFrame, n: int = 20) -> DataFrame:
    """Latest price, volume, volatility and trend sign per symbol."""
    from tidewater.operators.indicators import add_indicators

    x = add_indicators(bars, {"volatility": {"n": n}, "trend_sign": {"n": n}})
    row = F.max_by(F.struct("ts", "close", "volume", "volatility", "trend_sign"), "ts")
    return x.groupBy("symbol").agg(row.alias("r")).select("symbol", "r.*")


# -- model evaluation ---------------------------------------------------------------------
def prediction_quality(scored: DataFrame, key: str = "symbol") -> DataFrame:
    e, p = F.col("pred") - F.col("actual"), F.col("pred")
    hit = F.signum("pred") == F.signum("actual")
    return scored.groupBy(key).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(hit.cast("double")).alias("direction_accuracy"),
        F.avg(p).alias("bias"), F.var_pop(p).alias("variance"), F.avg(F.abs(p)).alias("confidence"))


def class_report(scored: DataFrame, band: float = 0.01) -> DataFrame:
    """Precision and recall of the classes -1 / 0 / 1 of prediction and outcome, per symbol."""
    cls = lambda c: F.when(F.col(c) > band, 1).when(F.col(c) < -band, -1).otherwise(0)
    m = scored.select("symbol", cls("pred").alias("p"), cls("actual").alias("a")).groupBy("symbol", "p", "a").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("label")
    x = m.select("symbol", "p", "a", "n", each)
    L = F.col("label")
    tp = F.sum(F.when((F.col("p") == L) & (F.col("a") == L), F.col("n")).otherwise(0))
    pp, ap = F.sum(F.when(F.col("p") == L, F.col("n")).otherwise(0)), F.sum(F.when(F.col("a") == L, F.col("n")).otherwise(0))
    return x.groupBy("symbol", "label").agg(
        tp.alias("true_positive"), ratio(tp, pp).alias("precision"), ratio(tp, ap).alias("recall"))


def confusion_matrix(scored: DataFrame, band: float = 0.01) -> DataFrame:
    """Rows per symbol, predicted class and actual class."""
    cls = lambda c: F.when(F.col(c) > band, 1).when(F.col(c) < -band, -1).otherwise(0)
    return scored.select("symbol", cls("pred").alias("predicted"), cls("actual").alias("actual")).groupBy("symbol", "predicted", "actual").agg(F.count(F.lit(1)).alias("rows"))


def class_weights(df: DataFrame, label: str, key: str) -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` per class."""
    n = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n_c"))
    total = n.groupBy(key).agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return n.join(total, key).withColumn("weight", F.col("n") / (F.col("k") * F.col("n_c")))


def stability_over_runs(runs: DataFrame) -> DataFrame:
    """Repeated predictions (run, id, pred): mean spread per row, range, mean correlation to run 0."""
    per_row = runs.groupBy("symbol", "id").agg(F.stddev_pop("pred").alias("s"), F.min("pred").alias("lo"), F.max("pred").alias("hi"))
    spread = per_row.groupBy("symbol").agg(F.avg("s").alias("mean_std"), (F.max("hi") - F.min("lo")).alias("prediction_range"))
    base = runs.where("run = 0").select("symbol", "id", F.col("pred").alias("p0"))
    c = runs.where("run > 0").join(base, ["symbol", "id"]).groupBy("symbol", "run").agg(F.corr("pred", "p0").alias("c"))
    return spread.join(c.groupBy("symbol").agg(F.avg("c").alias("consistency")), "symbol")


def boundary_stability(scored: DataFrame, samples: int = 100) -> DataFrame:
    """Share of sign flips between consecutive predictions at evenly spaced thresholds.

    A pair of neighbours flips at a threshold exactly when the threshold lies between them, so
    each pair adds +1 / -1 at two threshold indexes and flips are a prefix sum over 100 indexes
    instead of 100 copies of every row.
    """
    lim = scored.groupBy("symbol").agg(F.min("pred").alias("__lo"), F.max("pred").alias("__hi"))
    tl = lay_out(attach(scored, lim, "symbol"), "symbol", ["ts"], time_slice("ts", 30 * 86400), back=1)
    pairs = tl.add(__prev=tl.lag("pred")).rows().where("__prev IS NOT NULL")
    step = (F.col("__hi") - F.col("__lo")) / (samples - 1)
    index = lambda v: F.ceil((v - F.col("__lo")) / step - F.lit(1e-12)).cast("int")
    a, b = index(F.least("pred", "__prev")), index(F.greatest("pred", "__prev"))
    marks = pairs.select("symbol", F.explode(F.array(F.struct(a.alias("i"), F.lit(1).alias("d")), F.struct(b.alias("i"), F.lit(-1).alias("d")))).alias("m"))
    deltas = marks.groupBy("symbol", F.col("m.i").alias("i")).agg(F.sum("m.d").alias("d"))
    n = pairs.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    grid = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    from pyspark.sql import Window

    upto = Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(deltas, ["symbol", "i"], "left")
    return out.withColumn("flip_rate", F.coalesce(F.sum("d").over(upto), F.lit(0)) / F.col("n"))


def regime_sensitivity(scored: DataFrame) -> DataFrame:
    """Prediction statistics in overlapping regimes; needs volatility, p25, p75 and trend columns."""
    masks = {
        "high_volatility": F.col("volatility") > F.col("p75"), "low_volatility": F.col("volatility") < F.col("p25"),
        "uptrend": F.col("trend") > 0, "downtrend": F.col("trend") < 0}
    x = scored.withColumn("regime", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in masks.items()]))))
    return x.groupBy("symbol", "regime").agg(
        F.avg("pred").alias("mean_prediction"), F.stddev_pop("pred").alias("std_prediction"), F.avg(F.abs("pred")).alias("confidence"))
