"""A data quality engine on Spark DataFrames."""
