"""Structured Streaming jobs for landing folders."""
