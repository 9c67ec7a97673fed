"""Explicit schemas of the market entities."""

from pyspark.sql import types as T

_D, _L, _S, _TS = T.DoubleType(), T.LongType(), T.StringType(), T.TimestampType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


BAR = _schema(symbol=_S, timeframe=_S, ts=_TS, open=_D, high=_D, low=_D, close=_D, volume=_D)
BAR_CSV = _schema(symbol=_S, timestamp=_S, open=_D, high=_D, low=_D, close=_D, volume=_D)
TICK = _schema(
    trade_id=_L, symbol=_S, exchange=_S, ts=_TS, price=_D, amount=_D, side=_S, fee=_D, fee_currency=_S
)
LEVEL = T.StructType([T.StructField("price", _D), T.StructField("qty", _D)])
BOOK = _schema(symbol=_S, ts=_TS, bids=T.ArrayType(LEVEL), asks=T.ArrayType(LEVEL))
FUNDING = _schema(symbol=_S, ts=_TS, funding_rate=_D)
EVENT = _schema(event_id=_L, ts=T.TimestampNTZType(), user_id=_L, event_type=_S, value=_D, props=_S)

# JSON bodies as exchanges send them.
KLINES_JSON = "array<array<double>>"
TRADE_JSON = (
    "id bigint, timestamp bigint, symbol string, price double, amount double, side string, "
    "fee struct<cost:double,currency:string>"
)
BOOK_JSON = "timestamp bigint, symbol string, bids array<array<double>>, asks array<array<double>>"
FUTURES_JSON = (
    "timestamp bigint, symbol string, close double, mark double, index double, openInterest double, fundingRate double"
)
