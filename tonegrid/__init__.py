"""Song-catalogue analytics and pairing on Spark DataFrames."""
