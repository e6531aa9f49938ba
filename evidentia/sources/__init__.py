"""Readers of scientific text formats, and sinks."""
