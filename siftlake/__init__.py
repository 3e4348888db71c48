"""Content-moderation analytics on Spark DataFrames and streams."""
