"""Operators for training-data pipelines (documents, embeddings)."""
