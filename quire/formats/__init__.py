"""Kernels that read one document's bytes; none of them imports Spark."""
