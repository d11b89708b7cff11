"""Structured Streaming forms of the time-ordered operators."""
