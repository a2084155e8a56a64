"""Panels from files and tables, their validation, and sinks."""
