"""Batch and streaming analysis of failed pipeline runs, written on Spark DataFrames."""

__version__ = "0.1.0"
