"""Text retrieval, retrieval evaluation and text guarding on Spark DataFrames."""

__version__ = "0.1.0"
