"""Leafmill: document retrieval and text processing expressed as Spark plans."""

__version__ = "0.1.0"
