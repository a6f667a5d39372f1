"""Errors raised by the library."""


class TabloomError(Exception):
    """Base class."""


class DataLoadError(TabloomError):
    """A path cannot be read (absent, unsupported, undecodable, too small to split)."""


class LeakageError(TabloomError):
    """A critical leakage finding when the audit was asked to raise."""


class SchemaValidationError(TabloomError):
    """A column or type a step needs is missing."""


class ArtifactError(TabloomError):
    """An output location is invalid or already taken."""
