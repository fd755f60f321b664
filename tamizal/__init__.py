"""Tamizal: retrieval, knowledge and evaluation analytics for text corpora, on Spark DataFrames."""
