"""The row functions on arriving tickets."""
