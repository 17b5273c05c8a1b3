"""Readers and writers: triples, dumps, gold data, serialised graphs."""
