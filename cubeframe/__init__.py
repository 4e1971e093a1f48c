"""Analytics on datacubes kept as fragments: a row key and an array per row, on Spark DataFrames."""
