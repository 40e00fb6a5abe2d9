"""Retrieval analytics and corpus preparation as Spark plans."""
