"""Folds over joins, expressed and optimised for Spark."""
