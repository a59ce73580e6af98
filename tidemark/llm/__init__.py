"""Operators of a training-data pipeline: ten components and their queries."""
