"""Errors that callers see."""


class QueryError(Exception):
    """A statement that is malformed, names what is not there, or breaks a rule of its tables."""


class LoadError(QueryError):
    """A file that can't be loaded as asked."""
