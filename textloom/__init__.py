"""textloom: text analytics on Spark DataFrames, from raw posts to semantic search."""
