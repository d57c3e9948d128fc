"""Causeway: incident-graph analytics expressed as Spark DataFrames."""
