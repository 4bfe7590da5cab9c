"""Forum posts and their votes, analysed with Spark DataFrames."""
