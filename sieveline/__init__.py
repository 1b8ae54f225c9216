"""Content-scanning analytics on Spark: documents in, typed findings out."""

__version__ = "0.1.0"
