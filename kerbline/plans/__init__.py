"""Batch jobs built from the operators."""
