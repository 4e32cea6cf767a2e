"""Operators of a training-data pipeline over raw transaction lines and metadata addresses."""
