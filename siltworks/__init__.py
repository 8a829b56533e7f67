"""Spark-first analytics over code and text corpora."""
