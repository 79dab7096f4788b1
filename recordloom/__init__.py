"""Record integration and analytics on Spark DataFrames."""
