"""Incremental ingest, streaming bars and streaming MACD crossings."""
