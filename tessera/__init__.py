"""Analytics of the data around language models, on Spark DataFrames."""
