"""Keyed, append and topic sinks."""
