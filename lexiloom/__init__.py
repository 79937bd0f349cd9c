"""Spark-native document chunking, and operators for training corpora in the subpackage llm."""
