"""Operators that prepare text and records for the training of language models."""
