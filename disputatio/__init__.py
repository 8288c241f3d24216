"""Argument mining as Spark jobs: DataFrame-to-DataFrame operators over text corpora."""

__version__ = "0.1.0"
