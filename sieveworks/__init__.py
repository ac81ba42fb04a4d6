"""Sieveworks: relevance scoring and text preparation on Spark DataFrames."""

__version__ = "0.1.0"
