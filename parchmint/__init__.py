"""Analytics for corpora of transcribed document lines, on Spark DataFrames."""
