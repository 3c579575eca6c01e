"""Spark ML training and scoring built on the feature tables."""
