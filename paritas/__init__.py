"""Credit-decision audit engine on Spark DataFrames."""
