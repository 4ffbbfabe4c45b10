"""What the corpus operators share on the Spark side: scratch tables, column choice, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast up to this many bytes only.
BROADCAST_BYTES = 32 << 20

_own_scratch: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. Where it names none, a temporary one if everything runs in one process, as in
    tests; executors elsewhere couldn't read that, so there ValueError is raised."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share; the master is {master or 'unknown'}")
    if not _own_scratch:
        _own_scratch.append("file://" + tempfile.mkdtemp(prefix="tallyspark-"))
    return _own_scratch[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def parked(df: DataFrame, name: str) -> DataFrame:
    """df written to the scratch folder and read again: lineage ends there, and the loss of an executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, under our names; others, of whatever name, stay out of an operator's way."""
    return df.select(*[quoted(c).alias(n) for n, c in columns.items()])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def unused(taken: Iterable[str], *stems: str) -> tuple[str, ...]:
    """Column names made from the stems that differ from all taken ones, in any case of letters, and from each other."""
    held, out = {c.lower() for c in taken}, []
    for stem in stems:
        name, k = stem, 0
        while name.lower() in held:
            name, k = f"{stem}_{k}", k + 1
        held.add(name.lower())
        out.append(name)
    return tuple(out)


def schema_with(df: DataFrame, **changed: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f.name, changed.get(f.name, f.dataType), True) for f in df.schema])
