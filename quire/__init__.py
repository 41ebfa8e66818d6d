"""quire: document analytics on Spark DataFrames."""
