"""Structured Streaming over the files of successive runs."""
