"""Shape validation of graphs, and table operators, on Spark DataFrames."""
