"""Document screening, scoring and text preparation on Spark DataFrames."""
