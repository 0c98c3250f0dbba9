"""bibloom: catalogue-data analytics and training-corpus preparation on Spark DataFrames."""
