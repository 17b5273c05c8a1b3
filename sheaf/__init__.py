"""Sheaf: a knowledge-graph extraction engine on Spark DataFrames."""
