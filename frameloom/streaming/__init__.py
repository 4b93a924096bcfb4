"""Structured Streaming forms of the work-item operators."""
