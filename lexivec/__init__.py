"""Corpus and vector analytics over Spark DataFrames."""
