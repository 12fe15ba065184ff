"""Column lineage, change impact and policy analytics on Spark DataFrames."""
