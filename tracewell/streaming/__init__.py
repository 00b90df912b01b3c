"""Structured Streaming halves of the audit operators."""
