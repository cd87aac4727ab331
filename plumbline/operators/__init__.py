"""Operators on DataFrames: scoring, checks, run analytics, logs, retrieval."""
