"""Structured Streaming: the recorder and live divergences."""
