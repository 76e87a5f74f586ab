"""Quillmap: embedding-geometry analytics and training-corpus operators on Spark."""
