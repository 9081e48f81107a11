"""Operators of a training-data pipeline over the tables documents, embeddings, benchmark, labels and conversations."""
