"""Streaming generation and streaming checks."""
