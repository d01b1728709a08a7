"""Brand-share analytics over purchase logs, as lazy Spark DataFrames."""
