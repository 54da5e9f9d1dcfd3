"""Brindle: a Spark-first engine for image localisation, data integrity and profiling."""

__version__ = "0.1.0"
