"""Compositions of operators: preparation, clustering, forecasting."""
