"""loomspan: narrative-evaluation analytics as Spark DataFrames."""
