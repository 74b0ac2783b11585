"""figureproof: find the aggregate behind every published figure, on Spark."""

__version__ = "0.1.0"
