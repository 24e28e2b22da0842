"""Spark-first engine for retrieval question answering and corpus preparation."""
