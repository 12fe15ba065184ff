"""Column lineage read from Spark's analysed plans."""
