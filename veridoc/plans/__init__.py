"""Views over the sample tables and the catalogue of queries."""
