"""Views over the driver tables and the registry of queries."""
