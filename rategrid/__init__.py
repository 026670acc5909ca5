"""Sweep analytics on Spark: curves, intervals, crossings and GF(2) metrics over sweep tables."""

__version__ = "0.1.0"
