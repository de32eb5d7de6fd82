"""Parking-violation analytics as PySpark DataFrame operators."""
