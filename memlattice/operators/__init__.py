"""Graph, ranking, aggregation, sequence and lifecycle operators on DataFrames."""
