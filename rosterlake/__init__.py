"""Workforce-size estimation from public evidence, and corpus preparation, on Spark."""
