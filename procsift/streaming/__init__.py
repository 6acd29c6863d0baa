"""Incremental ingest of log folders, and alerts from frozen artifacts."""
