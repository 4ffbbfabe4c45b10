"""Analytics over brokerage-style event data as lazy Spark DataFrames."""

from .errors import SchemaMismatch, StatementError, TallyError, UnknownTable
from .plans.port import Port, Result, Stream, connect
from .session import session
from .streaming.changes import watch

__all__ = ["Port", "Result", "SchemaMismatch", "StatementError", "Stream", "TallyError", "UnknownTable", "connect", "session", "watch"]
