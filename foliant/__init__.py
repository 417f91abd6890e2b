"""foliant: annual-report segmentation and its measurement as Spark DataFrame operations."""

__version__ = "0.1.0"
