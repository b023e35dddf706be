"""Speech-translation corpus preparation, batching and scoring on Spark DataFrames."""
