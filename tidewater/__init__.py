"""Market-data analytics on Spark: bars, indicators, signals, trades, risk and streams."""
