"""Structured Streaming forms of the additive operators."""
