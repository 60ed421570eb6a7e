"""Spark-native analytics of OHLC time series: features, consolidation zones and breakouts."""
