"""Incremental ingest of triples as a stream of files."""
