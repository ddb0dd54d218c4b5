"""Structured Streaming: prediction, vocabulary and meters over streams."""
