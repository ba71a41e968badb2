"""Structured Streaming jobs for quality control, scoring and populations."""
