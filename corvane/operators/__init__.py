"""Operators of the engine: chunking, indexing, retrieval, dialogue, evaluation, latency analytics, curation."""
