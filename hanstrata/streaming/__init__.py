"""Structured Streaming variants of the stages."""
