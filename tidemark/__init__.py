"""Market time-series research jobs on Spark: every job is a function from DataFrame to DataFrame."""
