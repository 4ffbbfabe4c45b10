"""The query surface: a registry of tables and the operations on them, all lazy until a snapshot."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from types import MappingProxyType

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnknownTable
from ..functions.expr import check_name, compile_expression, compile_predicate
from ..operators import core
from ..types import CATALOG, DType, Schema, column, schema_of

HOWS = ("sum", "mean", "last", "count")


class Stream:
    """A running subscription. cancel() stops it, from its own callback too."""

    def __init__(self, query: object):
        self._query = query
        self.cancelled = False

    @property
    def failure(self) -> Exception | None:
        return self._query.exception()

    def cancel(self) -> None:
        if not self.cancelled:
            self.cancelled = True
            # a query can't stop itself from inside its batch function, which may run before start() has returned
            threading.Thread(target=self._stop, daemon=True).start()

    def _stop(self) -> None:
        while self._query is None:
            time.sleep(0.05)
        self._query.stop()

    def wait(self, seconds: float | None = None) -> None:
        self._query.awaitTermination(seconds) if seconds else self._query.awaitTermination()


@dataclass(frozen=True)
class Result:
    """A table, its logical schema, and the port it came from."""

    frame: DataFrame = field(repr=False)
    schema: Schema
    port: Port = field(repr=False)

    def snapshot(self) -> pa.Table:
        """The rows now, in canonical Arrow types. Run-time errors of an expression, such as overflow, raise ValueError."""
        names = [f.name for f in self.frame.schema if f.name != core.SEQ or self.schema.dtype(core.SEQ)]
        kinds = {f.name: DType.of(f.dataType) for f in self.frame.schema}
        out = self.frame.select(*[column(n).cast(kinds[n].spark).alias(n) for n in names])
        try:
            table = out.toArrow()
        except PySparkException as e:
            if e.getCondition() and e.getCondition().split(".")[0] in _RUN_TIME:
                raise ValueError(str(e).split("\n")[0]) from e
            raise
        return table.cast(pa.schema([(n, kinds[n].arrow) for n in names]))

    def subscribe(self, callback: Callable[[pa.Table], None]) -> Stream:
        """Calls back with the rows that are added from now on; see streaming.changes."""
        from ..streaming.changes import subscribe

        return subscribe(self, callback)

    def derive(self, /, **new: str) -> Result:
        return self.port.derive(self, columns=new)


_RUN_TIME = {"ARITHMETIC_OVERFLOW", "DIVIDE_BY_ZERO", "REMAINDER_BY_ZERO", "CAST_INVALID_INPUT", "CAST_OVERFLOW", "BINARY_ARITHMETIC_OVERFLOW", "FAILED_EXECUTE_UDF"}


def instant(text: str) -> datetime:
    """A moment from ISO-8601; without an offset it is UTC."""
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00") if isinstance(text, str) else text)
    except (TypeError, ValueError):
        raise ValueError(f"{text!r} is no ISO-8601 moment") from None
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC)


class Port:
    """Named tables and what can be asked of them. Derived tables are shared: everyone who looks one up gets the same plan."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self._tables = dict(tables)
        self._derived: dict[str, Result] = {}

    def table(self, name: str, /) -> Result:
        """A derived or a canonical table; a loaded table whose name the catalogue lacks is not served."""
        if name in self._derived:
            return self._derived[name]
        if name not in self._tables or name not in CATALOG:
            raise UnknownTable(f"there is no table {name!r}; there are {', '.join(sorted([*self._derived, *(t for t in self._tables if t in CATALOG)]))}")
        return Result(self._tables[name], CATALOG[name], self)

    def dataframe(self, name: str) -> DataFrame:
        """The Spark DataFrame behind a table, for what the surface doesn't offer."""
        return self.table(name).frame

    def _typed(self, result: Result) -> Schema:
        """The schema of what is really there: a loaded table may be narrower than its declaration."""
        return schema_of(result.frame)

    def filter(self, source: Result, predicate: str) -> Result:
        return Result(source.frame.where(compile_predicate(predicate, self._typed(source))), source.schema, self)

    def time_window(self, source: Result, *, start: str, end: str, column: str) -> Result:
        """Rows from start to end, both included."""
        self._need(source, [column], DType.TIMESTAMP_NS)
        return Result(source.frame.where(F.col("`" + column + "`").cast("timestamp").between(F.lit(instant(start)), F.lit(instant(end)))), source.schema, self)

    def group_by(self, source: Result, *, by: Sequence[str], aggs: Mapping[str, str]) -> Result:
        """Columns of `by`, then of `aggs`: {column: sum, mean, last or count}, under the columns' own names.

        last is the value that arrived last, null if that is null. count counts the group's rows, so its name need not be a column.
        """
        for name, how in aggs.items():
            if how not in HOWS:
                raise ValueError(f"{name}: {how!r} is no aggregation; there are {', '.join(HOWS)}")
        self._need(source, by)
        frame = core.arrival(source.frame) if "last" in aggs.values() else source.frame
        out = []
        for name in aggs:
            how = aggs[name]
            if "count" == how:
                out.append(F.count("*").alias(name))
                continue
            self._need(source, [name], *((DType.INT64, DType.FLOAT64) if how != "last" else ()))
            out.append({"sum": F.sum, "mean": F.avg, "last": lambda c: F.max_by(c, core.SEQ)}[how](column(name)).alias(name))
        keys = [column(b) for b in by]
        return self._result(frame.groupBy(*keys).agg(*out) if out else frame.select(*keys).distinct())

    def as_of_join(self, left: Result, right: Result, /, *, joins: Sequence[str], on: Sequence[str], bucket: float | None = None) -> Result:
        """Every left row with columns of the latest right row at or before it; on's last column orders, the others must be equal."""
        if not on:
            raise ValueError("an as-of join needs a column to order by")
        for side in (left, right):
            self._need(side, on)
        self._need(right, joins)
        order = on[-1]
        for side in (left, right):
            self._need(side, [order], DType.TIMESTAMP_NS, DType.INT64, DType.FLOAT64)
        return self._result(core.asof_join(left.frame, right.frame, on, joins, bucket=bucket))

    def sort(self, source: Result, *, keys: list[tuple]) -> Result:
        """Rows by (column, descending) pairs, later ones breaking ties; nulls are least."""
        self._need(source, [c for c, _ in keys])
        return Result(source.frame.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in keys]), source.schema, self)

    def derive(self, source: Result, *, columns: Mapping[str, str] = MappingProxyType({})) -> Result:
        """The table with further columns, expressions over its own columns alone."""
        schema = self._typed(source)
        new = {check_name(name): compile_expression(text, schema).value for name, text in columns.items()}
        kept = [column(c) for c in source.frame.columns if c not in new]
        return self._result(source.frame.select(*kept, *[x.alias(n) for n, x in new.items()]))

    def register_derived(self, name: str, *, columns: Mapping[str, str], base: str) -> Result:
        """A named table of base's columns and further ones. Its origin is untrusted: its expressions came from outside."""
        if name in CATALOG or name in self._derived or name in self._tables:
            raise ValueError(f"the name {name!r} is taken")
        made = self.derive(self.table(base), columns=columns)
        self._derived[name] = Result(made.frame, Schema(name, made.schema.fields), self)
        return self._derived[name]

    def derived_schema(self, name: str) -> Schema | None:
        return self._derived[name].schema if name in self._derived else None

    def derived_origin(self, name: str) -> str | None:
        return "untrusted" if name in self._derived else None

    def _result(self, frame: DataFrame) -> Result:
        return Result(frame, schema_of(frame), self)

    def _need(self, result: Result, names: Sequence[str], *dtypes: DType) -> None:
        schema = self._typed(result)
        for name in names:
            dtype = schema.dtype(name)
            if dtype is None:
                raise ValueError(f"there is no column {name}; the columns are {', '.join(schema.names)}")
            if dtypes and dtype not in dtypes:
                raise ValueError(f"{name} is {dtype.value}, not {' or '.join(t.value for t in dtypes)}")


def connect(tables: Mapping[str, DataFrame]) -> Port:
    """A port over named tables; nothing runs yet."""
    return Port(tables)
