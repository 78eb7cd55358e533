"""Structured Streaming: incremental bronze -> silver cleaning with the batch cleaners."""

from .refresh import CLEANERS, cleaned_stream, start_silver_refresh

__all__ = ["CLEANERS", "cleaned_stream", "start_silver_refresh"]
