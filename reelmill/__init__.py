"""Reelmill: archive-credits analytics on Spark DataFrames."""
