"""Evidence, run-log and model-object tables as plain Spark DataFrames."""
