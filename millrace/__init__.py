"""Corpus preparation and completion evaluation as lazy Spark plans."""
