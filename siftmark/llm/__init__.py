"""Operators for preparing training data, written as Spark jobs."""
