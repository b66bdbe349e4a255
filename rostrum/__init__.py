"""Civic-records analytics on Spark: relational, text, spatial and model operators over DataFrames."""
