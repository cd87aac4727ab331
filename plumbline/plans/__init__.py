"""Registered queries: operators applied to the tables at hand, each with its oracle."""
