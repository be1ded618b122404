"""Readers, writers and run configuration."""
