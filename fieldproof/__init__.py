"""Spark-first analytics for checking how written answers express structured records."""

__version__ = "0.1.0"
