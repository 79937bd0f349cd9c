"""Chunking operators: DataFrames of documents, blocks or rows in, DataFrames of chunks out."""
