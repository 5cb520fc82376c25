"""Operators of a training-data pipeline. Nothing outside this folder, but the pipeline file, imports it."""
