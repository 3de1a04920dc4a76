"""Errors raised by the library."""


class VicinalError(Exception):
    """Base of all errors of the library."""


class InvalidOptionError(VicinalError, ValueError):
    """An option of a search is out of range."""


class NotFittedError(VicinalError):
    """A search was asked of an estimator without an index."""


class VectorError(VicinalError, ValueError):
    """Vectors are missing, empty, of unequal lengths, or hold null or non-finite elements."""


class FileFormatError(VicinalError, ValueError):
    """A vector file's header and content disagree."""
