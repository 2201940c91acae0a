"""Point-in-time analytics on Spark: bitemporal stores, time-series operators and statistics as DataFrame plans."""
