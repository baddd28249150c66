"""vellumflow: document extraction, quality and privacy analytics as Spark plans."""

__version__ = "0.1.0"
