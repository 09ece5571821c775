"""Market-bar analytics on Spark: bars, factors, signals, trades and metrics as DataFrame operators."""
