"""Structured Streaming: the index queue and rate limits."""
