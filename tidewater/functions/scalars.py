"""Column helpers: guarded arithmetic, text normalisation, market identifiers, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def ratio(a, b, on_zero=None) -> Column:
    """``a / b``; NULL (or ``on_zero``) where the denominator is zero.

    Both arguments are evaluated once, so window expressions may be passed in.
    """
    a, b = _c(a), _c(b)
    out = F.try_divide(a, b)
    return out if on_zero is None else F.when(b == 0, F.lit(on_zero)).otherwise(out)


def clamp(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def logistic(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def nan_to_null(x) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def clean_symbol(x, separator: str = "_") -> Column:
    """``btc/usdt`` -> ``BTC_USDT`` (or ``BTCUSDT`` with an empty separator)."""
    return F.regexp_replace(F.upper(F.trim(_c(x))), "[/\\-_]", separator)


def is_symbol(x) -> Column:
    return F.upper(F.trim(_c(x))).rlike("^[A-Z0-9]{2,20}([/_-]?[A-Z0-9]{2,10})?$")


# The timeframes the data model accepts, in seconds.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}


def timeframe_seconds(x) -> Column:
    x, out = _c(x), None
    for name, seconds in TIMEFRAMES.items():
        out = F.when(x == name, seconds) if out is None else out.when(x == name, seconds)
    return out


def normal_side(x) -> Column:
    x = F.lower(F.trim(_c(x)))
    return F.when(x.isin("buy", "long", "bid"), "buy").when(x.isin("sell", "short", "ask"), "sell")


# Order types and states of the order model.
ORDER_TYPES = ("market", "limit", "stop_loss", "take_profit")
ORDER_STATES = ("pending", "open", "filled", "cancelled", "rejected")


def is_order_type(x) -> Column:
    return F.lower(_c(x)).isin(*ORDER_TYPES)


def parse_millis(x) -> Column:
    """Epoch milliseconds to timestamp."""
    return F.timestamp_millis(_c(x).cast("long"))


def row_digest(*cols: str) -> Column:
    """SHA-256 over the JSON of the named columns."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def clean_text(x) -> Column:
    """Lower case without punctuation, letters of all scripts kept."""
    return F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}_\s]", "")


def words(x, stop: tuple[str, ...] = ()) -> Column:
    """Tokens of the cleaned text without stop words."""
    tokens = F.filter(F.split(clean_text(x), r"\s+"), lambda w: F.length(w) > 0)
    return F.filter(tokens, lambda w: ~w.isin(*stop)) if stop else tokens


# English stop words.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself he him his himself she her hers herself it its
    itself they them their theirs what which who whom this that these those am is are was were be been being have has
    had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor not only own same so than too very
    s t can will just don should now""".split()
)


def uniform(*parts) -> Column:
    """Repeatable uniform number in [0, 1) from identifying values.

    Unlike ``rand(seed)`` it does not depend on partitioning or row order, so a recomputed task
    draws the same numbers.
    """
    text = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def gaussian(*parts) -> Column:
    """Repeatable standard normal number (Box-Muller on two uniforms)."""
    u = (uniform(*parts, F.lit("u")) * 4294967296.0 + 0.5) / 4294967296.0
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * uniform(*parts, F.lit("v")))
