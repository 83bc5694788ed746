"""Operators for preparing training data of language models, at the scale of a cluster."""
