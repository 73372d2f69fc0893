"""Retirement projections, document field extraction and training-data preparation on Spark DataFrames."""
