"""Lodestack: acquisition, cleaning, comparison and ranking of semi-structured records on Spark."""

__version__ = "0.1.0"
