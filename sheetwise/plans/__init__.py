"""Views over the given tables and the catalogue of queries."""
