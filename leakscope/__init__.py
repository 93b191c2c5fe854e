"""Benchmark-contamination forensics and training-data preparation on Spark DataFrames."""
