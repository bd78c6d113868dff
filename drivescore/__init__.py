"""Spark operators for scoring variants of cancer genes, and for the tables around them."""
