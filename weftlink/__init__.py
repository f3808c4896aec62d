"""Record linkage and corpus preparation on Spark DataFrames."""
