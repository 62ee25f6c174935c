"""Structured Streaming forms of the daily activity operators."""
