"""Entity-component tables, change feeds and training-data operators on Spark DataFrames."""
