"""Relational, graph and linkage operators."""
