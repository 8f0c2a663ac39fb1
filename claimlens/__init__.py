"""Multi-document consistency audit engine on Spark DataFrames."""
