"""Spark operators for curating, scoring and screening large experiment tables."""
