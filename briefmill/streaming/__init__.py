"""Streams of files, status rows and events, as Structured Streaming plans."""
