"""Structured Streaming entry points for the row-local harmonisation steps."""

from reefline.streaming.harmonise_stream import harmonise_rows, read_rates_stream, start_harmonise_stream

__all__ = ["harmonise_rows", "read_rates_stream", "start_harmonise_stream"]
