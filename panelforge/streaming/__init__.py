"""Streaming ingest of panels, beyond the batch operators."""
