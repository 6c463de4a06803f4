"""Text and report pipelines on Spark DataFrames."""
