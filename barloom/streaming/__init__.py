"""Structured Streaming versions of tick jobs."""
