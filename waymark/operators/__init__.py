"""Relational, trajectory, spatial and graph operators over DataFrames."""
