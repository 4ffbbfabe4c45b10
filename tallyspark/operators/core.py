"""Relational building blocks: latest and first rows by key, natural and as-of joins, key-value pivots."""

from __future__ import annotations

import collections.abc as abc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import column

#: Name of the column that numbers rows in the order they arrived.
SEQ = "_seq"


def arrival(df: DataFrame) -> DataFrame:
    """df with an arrival number; where it has none, the order it is read in. Only sources may be numbered so, before any shuffle.

    Files have no order among each other, so a table of several files must bring its numbers, in a column _seq; ValueError if it doesn't.
    """
    if SEQ in df.columns:
        return df
    if not df.isStreaming and len(df.inputFiles()) > 1:
        raise ValueError(f"a table of several files needs a column {SEQ} that says in which order its rows arrived")
    return df.withColumn(SEQ, F.monotonically_increasing_id())


#: Types whose values an aggregation can replace in place, so that it needs no sort.
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _one_by(df: DataFrame, keys: abc.Sequence[str], pick: abc.Callable[[Column, Column], Column], seq: str) -> DataFrame:
    """A row for each key. Fixed-width columns are picked one by one, by hashing alone; others together as a struct, for which both sides of the shuffle are sorted by key.
    Both see the same rows in the same order, so of rows that tie they pick the same one."""
    rest = [f for f in df.schema if f.name not in keys]
    narrow = [f.name for f in rest if isinstance(f.dataType, _FIXED) and not isinstance(f.dataType, T.DecimalType)]
    if len(narrow) == len(rest):
        found = df.groupBy(*map(column, keys)).agg(*[pick(column(c), column(seq)).alias(c) for c in narrow]) if rest else df.select(*map(column, keys)).distinct()
        return found.select(*map(column, df.columns))
    whole = df.groupBy(*map(column, keys)).agg(pick(F.struct(*[column(f.name) for f in rest]), column(seq)).alias("__one"))
    return whole.select(*[column(c) if c in keys else F.col("__one").getField(c).alias(c) for c in df.columns])


def last_by(df: DataFrame, keys: abc.Sequence[str], seq: str = SEQ) -> DataFrame:
    """The row of each key that arrived last, whole, nulls in it kept. Partial results are combined before the shuffle."""
    return _one_by(df, keys, F.max_by, seq)


def first_by(df: DataFrame, keys: abc.Sequence[str], seq: str = SEQ) -> DataFrame:
    """The row of each key that arrived first."""
    return _one_by(df, keys, F.min_by, seq)


def natural_join(left: DataFrame, right: DataFrame, on: abc.Sequence[tuple[str, str]], bring: abc.Sequence[str], seq: str | None = SEQ) -> DataFrame:
    """left with columns of the one right row of equal keys, or nulls.

    Of several right rows with a key the one that arrived last counts, so left rows never multiply; with seq None the
    right side must be unique already. Right columns named like left ones replace them.
    """
    slim = right.select(*[column(r).alias(f"__r{i}") for i, (_, r) in enumerate(on)], *[column(b).alias(f"__b{i}") for i, b in enumerate(bring)], *([column(seq).alias("__seq")] if seq else []))
    keys = [f"__r{i}" for i in range(len(on))]
    if seq:
        slim = last_by(slim, keys, "__seq").drop("__seq")
    condition = F.lit(True)
    for (own, _), key in zip(on, keys):
        condition = condition & (column(own) == F.col(key))
    joined = left.join(slim, condition, "left")
    return joined.select(*[column(c) for c in left.columns if c not in bring], *[F.col(f"__b{i}").alias(b) for i, b in enumerate(bring)])


def asof_join(left: DataFrame, right: DataFrame, on: abc.Sequence[str], bring: abc.Sequence[str], seq: str = SEQ, *, bucket: float | None = None) -> DataFrame:
    """left with columns of the latest right row at or before it, or nulls.

    All of `on` but the last are keys that must be equal, the last is the ordered one. Of right rows at the same place the one that arrived
    last counts. Null keys match nothing; left rows all stay. One shuffle on the equality keys and one sort: both
    sides are merged, and the last right row so far is carried along in a struct, so that nulls in it count too. Right columns named
    like left ones replace them. Without equality keys everything meets in one partition, and so do the rows of a hot key, unless `bucket` is given: then each stretch
    of so many units of the ordered column, seconds for times, is a partition of its own, and the last right row of each is handed on to the stretches after it,
    which takes a row for each key and stretch.
    """
    *equal, order = on
    names = [c for c in left.columns if c not in bring]
    right = right if seq in right.columns else right.withColumn(seq, F.lit(0))
    usable = F.lit(True)
    for c in on:
        usable = usable & column(c).isNotNull()
    carried = F.struct(*[column(b).alias(f"b{i}") for i, b in enumerate(bring)])
    kind = right.select(carried.alias("x")).schema["x"].dataType
    row = F.struct(*map(column, names)) if names else F.struct(F.lit(0).alias("none"))
    keys = [column(c).alias(f"__k{i}") for i, c in enumerate(equal)]
    lefts = left.select(*keys, column(order).alias("__o"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__s"), F.lit(None).cast(kind).alias("__x"), row.alias("__row"), usable.alias("__ok"))
    rights = right.where(usable).select(*keys, column(order).alias("__o"), F.lit(0).alias("__side"), column(seq).cast("long").alias("__s"), carried.alias("__x"), F.lit(None).cast(lefts.schema["__row"].dataType).alias("__row"), F.lit(True).alias("__ok"))
    parts = [f"__k{i}" for i in range(len(equal))]
    both, everything = lefts.unionByName(rights), Window.unboundedPreceding
    if bucket is not None:
        both = both.withColumn("__b", F.floor(F.col("__o").cast("double") / bucket))
    window = Window.partitionBy(*parts, *(["__b"] if bucket is not None else [])).orderBy("__o", "__side", "__s").rowsBetween(everything, 0)
    merged = both.withColumn("__hit", F.last("__x", ignorenulls=True).over(window)).where("__side = 1")
    if bucket is not None:
        last = both.groupBy(*parts, "__b").agg(F.max_by("__x", F.when(F.col("__side") == 0, F.struct("__o", "__s"))).alias("__last"))
        before = last.withColumn("__before", F.last("__last", ignorenulls=True).over(Window.partitionBy(*parts).orderBy("__b").rowsBetween(everything, -1))).where("__before IS NOT NULL")
        before = before.select(*[F.col(c).alias(f"{c}_of") for c in [*parts, "__b"]], "__before")
        same = F.lit(True)
        for c in [*parts, "__b"]:
            same = same & (F.col(c) == F.col(f"{c}_of"))
        merged = merged.join(before, same, "left").withColumn("__hit", F.coalesce("__hit", "__before"))
    hit = F.when(F.col("__ok"), F.col("__hit"))
    return merged.select(*[F.col("__row").getField(c).alias(c) for c in names], *[hit.getField(f"b{i}").alias(b) for i, b in enumerate(bring)])


def pivot_latest(df: DataFrame, by: abc.Sequence[str], key: str, value: str, wanted: abc.Mapping[str, str], driver: str, carry: abc.Mapping[str, str] | None = None, seq: str = SEQ) -> DataFrame:
    """A row for each `by` with the latest `value` of each wanted key as a column: {key: column name}.

    Only groups that have the driving key appear; `carry` brings further columns {column: name} of its latest row. One pass, whatever the number of keys.
    """

    def latest(x: Column, k: str) -> Column:
        return F.max_by(x, F.when(column(key) == k, column(seq)))

    aggs = [latest(column(value), k).alias(n) for k, n in wanted.items()] + [latest(column(c), driver).alias(n) for c, n in (carry or {}).items()]
    some = df.where(column(key).isin(*dict.fromkeys([*wanted, driver])))
    return some.groupBy(*map(column, by)).agg(*aggs, F.max(column(key) == driver).alias("__driven")).where("__driven").drop("__driven")
