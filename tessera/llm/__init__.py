"""Operators for training-data pipelines: cleaning, scoring, joining, mixing and formatting of corpora."""
