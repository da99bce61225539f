"""quorix: nearest-neighbour decisioning on Spark DataFrames."""
