"""Strict-past analytics over timestamped money transfers, expressed as Spark DataFrames."""
