"""Feeds, change events and table scans."""
