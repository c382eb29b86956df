"""Structured Streaming forms of the pipeline and of the health rules."""
