"""Errors: one root, so that callers can catch all; some are also Python's own kinds."""


class AnnotationError(Exception):
    """Root of all errors raised here."""


class InvalidAnnotation(AnnotationError):
    """Content that breaks the type catalog."""


class UnequalLengths(InvalidAnnotation):
    """Parallel lists of different lengths."""


class UnknownType(AnnotationError, KeyError):
    """A tag or version that the catalog doesn't have."""

    def __str__(self) -> str:
        return Exception.__str__(self)


class BadArgument(AnnotationError, ValueError):
    """An argument that is missing, left over or out of range."""


class BadFormat(AnnotationError):
    """A file or a value that can't be read or written."""
