"""Structured Streaming forms of the core features."""
