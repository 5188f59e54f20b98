"""Readers for delimited and JSON files, and raw landing."""

from martloom.sources.files import list_sources, scan

__all__ = ["list_sources", "scan"]
