"""Incremental folder ingest."""
