"""Catalogue analytics on Spark: ingestion, shaping, scoring, ranking and evaluation as DataFrame operators."""
