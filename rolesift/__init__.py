"""Job-postings analytics on Spark DataFrames."""
