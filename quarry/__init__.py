"""Search and analysis of code and text as Spark DataFrames."""
