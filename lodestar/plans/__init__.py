"""Whole plans: the search engine facade, the dataset registry, and the registered queries with their SQL."""
