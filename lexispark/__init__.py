"""Semantic analytics on Spark DataFrames: start with lexispark.session.Session."""
