"""Corpus grooming and training-set preparation on Spark DataFrames."""
