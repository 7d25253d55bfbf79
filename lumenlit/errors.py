"""Error types. Arguments are validated when a plan is built, before any job starts."""

from __future__ import annotations


class LumenlitError(Exception):
    """Base of all errors raised by this package."""


class QueryError(LumenlitError, ValueError):
    """A query text that cannot be parsed or ranked; knows the place of the fault."""

    def __init__(self, message: str, position: int | None = None, token: str | None = None):
        super().__init__(message)
        self.position = position
        self.token = token


class FilterError(LumenlitError, ValueError):
    """A metadata or range filter that is malformed."""


class StoreError(LumenlitError):
    """A table that is missing, newer than this code, or not built for the request."""


class ParsingError(LumenlitError):
    """Bytes that are no readable document."""


class FusionError(LumenlitError, ValueError):
    """Lists or parameters that cannot be fused."""


class ConfigError(LumenlitError, ValueError):
    """An unknown or malformed setting."""


class PipelineAborted(LumenlitError):
    """A run that stopped early; ``partial_count`` records were settled."""

    def __init__(self, message: str, partial_count: int = 0):
        super().__init__(message)
        self.partial_count = partial_count


class PipelineInterrupted(PipelineAborted):
    """A run that was asked to stop and finished its current page first."""


class StaleCursor(LumenlitError):
    """A listing cursor its source no longer accepts."""
