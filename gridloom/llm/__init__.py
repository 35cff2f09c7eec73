"""Operators for preparing training data: ten methods and the pipeline built from five of them."""
