"""Scoring of argument files as they arrive, with the functions of the batch jobs."""

from labelloom.streaming.arguments import stream_arguments, write_stream

__all__ = ["stream_arguments", "write_stream"]
