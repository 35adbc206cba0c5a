"""Memory-graph and document analytics on Spark DataFrames."""
