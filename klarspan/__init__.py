"""klarspan: evidence and claim analytics on Spark DataFrames."""
