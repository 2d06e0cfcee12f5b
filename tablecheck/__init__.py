"""Data-quality analytics on Spark: checks, contracts, profiles, metric history, result analytics."""
