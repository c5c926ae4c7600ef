"""Operators of a training-data pipeline: text, urls, embeddings, models."""
