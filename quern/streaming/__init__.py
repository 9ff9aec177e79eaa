"""Results as streams of rows."""

from .rows import stream_rows

__all__ = ["stream_rows"]
