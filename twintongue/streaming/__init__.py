"""Streams into an engine's tables."""
