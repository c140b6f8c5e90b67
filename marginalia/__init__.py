"""Marginalia: books and pages with notes, as Spark DataFrames."""
