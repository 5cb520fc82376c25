"""Spark jobs for motif-anchored sequence queries and for training-data pipelines."""
