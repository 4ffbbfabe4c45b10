"""Packing token sequences into windows by minimum bin slack.

A window's contents depend on the lengths alone, and there are at most as many lengths as a window has places, however
many documents there are. So windows are planned on the counts of each length: the longest length left opens a window, a
subset-sum over the remaining multiset of lengths, as a bitset, finds the sum that comes closest to capacity, and going back through
its stages gives how often each length is taken. A window's pattern is repeated as often as the counts allow. Documents then find their
places by their rank among those of their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as N
from .shared import BROADCAST_BYTES, parked, pick
from .tokens import VOCABULARY, ids

CAPACITY = 2048


class Pattern(NamedTuple):
    """Lengths and how often each stands in a window, longest first; the pattern fills windows first .. first + times - 1."""

    parts: list[tuple[int, int]]
    first: int
    times: int


def closest(lengths: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """Of the multiset of (length, count), the choice whose sum comes closest to room without exceeding it."""
    mask, reach = (1 << (room + 1)) - 1, 1
    stages: list[tuple[int, int, int]] = []
    for length, count in lengths:
        left, step, before = min(count, room // length), 1, reach
        if not left:
            continue
        while left:
            step = min(step, left)
            reach |= (reach << (length * step)) & mask
            left, step = left - step, step * 2
        stages.append((length, min(count, room // length), before))
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, count, before in reversed(stages):
        times = 0
        while not before >> total & 1:
            total, times = total - length, times + 1
        if times:
            chosen.append((length, times))
    return chosen[::-1]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns of windows for so many sequences of each length, from 1 to capacity."""
    left, out, window = dict(sorted(counts.items(), reverse=True)), [], 0
    while left:
        longest = next(iter(left))
        rest = [(n, c - (n == longest)) for n, c in left.items() if c - (n == longest)]
        parts = {longest: 1}
        for n, times in closest(rest, capacity - longest):
            parts[n] = parts.get(n, 0) + times
        times = min(left[n] // k for n, k in parts.items())
        out.append(Pattern(sorted(parts.items(), reverse=True), window, times))
        window += times
        for n, k in parts.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs under the vocabulary, repeated rows and those with a null id too; a null or empty text has none.

    Texts count whole, however long. Ids are whole numbers; other columns are ignored, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in N.pieces(batches):
            n = [len(ids(x.as_py(), vocabulary)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long")


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(window_id, position, doc_id, first_token, n_tokens): where each piece of the sequences (doc_id, n_tokens) stands.

    A sequence longer than capacity, however long, first fills whole windows by itself; what remains is packed with the others. Windows have
    numbers from 0 without gaps, the whole ones last. Sequences without tokens, or with a null length, have no place; an empty table gives none. Among
    sequences of one length, ids decide, nulls first; rows with equal ids and lengths are interchangeable, each has its own place. Other columns are ignored.

    Rows are laid out by length and id in parts of about equal size, so a length that most sequences have takes many tasks; a row's rank among those of its length
    is its rank within its part and the number of them in parts before.
    """
    spark = lengths.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = parked(lengths.where("n_tokens > 0").selectExpr("doc_id", "n_tokens", f"n_tokens div {capacity} AS whole", f"n_tokens % {capacity} AS rest"), "lengths")
    lengths = parked(whole.repartitionByRange(n, "rest", "doc_id", "n_tokens").withColumn("part", F.spark_partition_id()), "lengths-by-part")
    met = sorted(tuple(r) for r in lengths.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")).collect())
    counts, before = {}, []
    for part, rest, n_rows, _ in met:
        before.append((part, rest, counts.get(rest, 0)))
        counts[rest] = counts.get(rest, 0) + n_rows
    patterns = plan({rest: c for rest, c in counts.items() if rest}, capacity)
    rows, used = [], {}
    for parts, first, times in patterns:
        at = 0
        for length, k in parts:
            low = used.get(length, 0)
            used[length] = low + k * times
            rows.append((length, low, used[length], k, first, at))
            at += length * k
    places = _side(spark, rows, "rest long, low long, high long, k long, first long, at long")
    ranks = _side(spark, before, "part int, rest long, base long")
    ranked = lengths.where("rest > 0").selectExpr("*", "row_number() OVER (PARTITION BY part, rest ORDER BY doc_id NULLS FIRST, n_tokens) - 1 AS own").join(ranks, ["part", "rest"]).withColumn("r", F.col("base") + F.col("own"))
    packed = ranked.join(places, (ranked["rest"] == places["rest"]) & (F.col("r") >= F.col("low")) & (F.col("r") < F.col("high"))).select(
        F.expr("first + (r - low) div k").alias("window_id"), (F.col("at") + F.expr("(r - low) % k") * ranked["rest"]).alias("position"), "doc_id", (F.col("n_tokens") - ranked["rest"]).alias("first_token"), ranked["rest"].alias("n_tokens")
    )
    at, of_part = patterns[-1].first + patterns[-1].times if patterns else 0, {}
    for part, _, _, windows in met:
        of_part.setdefault(part, at)
        at += windows
    offsets = _side(spark, list(of_part.items()), "part int, at long")
    run = "sum(whole) OVER (PARTITION BY part ORDER BY rest, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) - whole"
    full = lengths.where("whole > 0").withColumn("run", F.expr(run)).join(offsets, "part").select("doc_id", F.expr("at + run").alias("at"), F.explode(F.expr("sequence(0L, whole - 1)")).alias("i"))
    full = full.select((F.col("at") + F.col("i")).alias("window_id"), F.lit(0).cast("long").alias("position"), "doc_id", (F.col("i") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"))
    return packed.unionByName(full)


def _side(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    side = spark.createDataFrame(rows, schema)
    return F.broadcast(side) if len(rows) * 64 <= BROADCAST_BYTES else side
