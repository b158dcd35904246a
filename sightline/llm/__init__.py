"""Operators of a training-data pipeline; ``queries`` registers them."""
