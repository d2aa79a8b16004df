"""Two-clock demand analytics on Spark DataFrames."""
