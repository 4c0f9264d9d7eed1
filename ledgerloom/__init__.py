"""Reconciliation intake and training-data preparation on Spark DataFrames."""
