"""Streams into managed datasets, and windowed counts of event streams."""

from tessera.streaming.ingest import drain, event_counts

__all__ = ["drain", "event_counts"]
