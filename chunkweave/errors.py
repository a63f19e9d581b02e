"""Errors that callers can tell apart."""


class SubChunkIndexingError(ValueError):
    """A slice would split individual chunks."""
