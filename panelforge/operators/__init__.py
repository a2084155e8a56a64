"""Operators on panels, households, features, clusters and forecasts."""
