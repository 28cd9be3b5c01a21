"""Tessera: code-and-log risk analysis over Spark DataFrames."""
