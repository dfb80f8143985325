"""Duplication analytics on Spark: windows, candidates, scores, clusters and reports as DataFrame plans."""
