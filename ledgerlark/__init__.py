"""Retail sales cleaning, metrics and question answering as Spark DataFrames."""
