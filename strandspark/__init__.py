"""Spark-native analytics over sequencing data: alignments, intervals, reads and gene models."""

__version__ = "0.1.0"
