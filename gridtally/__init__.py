"""Evaluation of detections and counts as Spark DataFrame operators."""

__version__ = "0.1.0"
