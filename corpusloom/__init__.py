"""Corpus preparation and retrieval as Spark DataFrame jobs."""
