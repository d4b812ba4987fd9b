"""Multi-timeframe bar analytics on Spark DataFrames."""
