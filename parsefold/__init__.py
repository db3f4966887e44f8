"""Document text analytics as Spark DataFrames."""
