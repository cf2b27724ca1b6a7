"""Spatial, trajectory and reconciliation analytics as Spark DataFrame plans."""
