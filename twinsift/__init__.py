"""Near-duplicate analytics on Spark: plans are DataFrames, Python only where a kernel needs it."""
