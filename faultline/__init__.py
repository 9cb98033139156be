"""Incident-evidence engine on Spark DataFrames."""
