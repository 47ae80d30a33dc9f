"""Structured Streaming jobs: source -> operator -> sink."""
