"""Exceptions of the engine."""


class VecframeError(Exception):
    """Base of all errors raised here."""


class DimensionMismatch(VecframeError):
    """A vector has another dimension than its collection."""


class InvalidVector(VecframeError):
    """A vector has components that aren't finite."""


class ConfigError(VecframeError):
    """A setting, name or value is not allowed."""


class NotFound(VecframeError):
    """Something named does not exist."""


class StorageError(VecframeError):
    """Stored data are missing, damaged or read-only."""


class LockConflict(StorageError):
    """Another writer has the database."""


class ParseError(VecframeError):
    """A query text is malformed."""
