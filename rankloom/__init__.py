"""rankloom: link analysis on Spark DataFrames."""
