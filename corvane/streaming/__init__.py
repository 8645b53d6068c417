"""Structured Streaming forms of ingestion and of latency statistics (an extension of the batch engine)."""
