"""Operators for training-data pipelines: filters, searches, classifiers, tokens, archives and deduplication."""
