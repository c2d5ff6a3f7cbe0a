"""Taxonomy classification of large text tables as Spark jobs."""
