"""Dependency and message-flow analytics on Spark DataFrames."""
