"""Streams of customer events."""
