"""Errors, raised while a plan is built and never inside tasks."""


class LexigridError(Exception):
    """Base of all errors of the library."""


class NotAllowedValue(LexigridError, ValueError):
    """A parameter's value is outside its range."""


class IncompatibleValue(LexigridError, ValueError):
    """Two parameters don't go together."""


class UnsupportedType(LexigridError, TypeError):
    """An input is of a kind that can't be used here."""


class ResourceNotFound(LexigridError, FileNotFoundError):
    """A file isn't there."""


class RequiredValue(LexigridError, ValueError):
    """A parameter is missing."""


class OutOfVocabulary(LexigridError, KeyError):
    """A word isn't in the vocabulary."""
