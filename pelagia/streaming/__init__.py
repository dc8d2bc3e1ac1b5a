"""Structured Streaming forms of watching, clustering and deferred deletion."""
