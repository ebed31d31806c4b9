"""Structured Streaming forms of the engagement and arrival operators."""
