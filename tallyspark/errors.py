"""Exceptions of the package. Wrong arguments raise ValueError."""


class TallyError(Exception):
    """Base of the package's own exceptions."""


class UnknownTable(TallyError):
    """A name that neither a canonical nor a derived table has."""


class SchemaMismatch(TallyError):
    """A table that lacks a declared column or has it in another type."""


class StatementError(TallyError):
    """A statement that can't be read: malformed, not ready yet, or refused."""
