"""Relevance analytics over document collections, built on Spark DataFrames."""

__version__ = "0.1.0"
