"""Sharding by sampled splitters.

A sample, in which a record's chance follows its bytes, gives the splitters: the quantiles of its keys cut the key
space into ranges of about equal bytes, RANGES of them or as many as it takes to keep a range at RANGE_BYTES. Ranges that exceed the limit all the same are subdivided
exactly, by running bytes in key order over the narrow key and size columns. Records find their range by binary search, and then go to their
shards in a single shuffle, a partition to each shard, and lie there in key order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BROADCAST_BYTES, parked, quoted, unused

#: Ranges at least; more where they would exceed RANGE_BYTES.
RANGES = 256
RANGE_BYTES = 128 << 20
#: Sampled records for each range.
OVERSAMPLE = 64
#: A range may have this many times the mean bytes before it is subdivided.
SLACK = 1.25
MAX_SHARD_BYTES = 256 << 20


def _rank(splitters: str, key: Column, most: int) -> Column:
    """How many entries of the sorted array column `splitters`, of `most` entries at most, are at most the key; 0 where it is null. By binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most.bit_length())))])
    size = F.coalesce(F.size(F.col(splitters)), F.lit(0))
    return F.aggregate(steps, F.lit(0), lambda i, s: F.when((i + s <= size) & (F.get(splitters, i + s - 1) <= key), i + s).otherwise(i))


def shards(docs: DataFrame, keys: tuple[str, ...] = ("source", "doc_id"), text_col: str = "text", *, ranges: int | None = None, oversample: int = OVERSAMPLE, slack: float = SLACK, max_shard_bytes: int = MAX_SHARD_BYTES) -> DataFrame:
    """docs with range_id and sub_id, which together name each row's shard, laid out by shard, a partition to each, and in key order.

    Keys compare column by column, nulls first. A shard's limit is the lesser of max_shard_bytes and slack times a range's mean bytes of
    text, null as 0; texts count whole, however long. Rows of one key stay in one shard, however many they are, so a shard exceeds the limit by the rows of one key
    at most. Shard (r, s) precedes (r, s + 1) and (r + 1, 0) in key order. An empty table gives an empty result.
    Columns of docs that are named range_id or sub_id are replaced; others, of whatever name, stay. Without `ranges` their number follows the bytes. There are fewer than
    that only where their splitters would be too many to broadcast; subdivision then makes up for it.
    """
    docs = docs.drop("range_id", "sub_id")
    spark = docs.sparkSession
    key = F.struct(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)])
    slim = parked(docs.select(key.alias("k"), F.coalesce(F.octet_length(quoted(text_col)), F.lit(0)).cast("long").alias("b")), "keys")
    name = F.concat_ws("/", *[F.coalesce(F.col(f"k.k{i}").cast("string"), F.lit("")) for i in range(len(keys))])
    total, mean_key = slim.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.avg(F.octet_length(name)), F.lit(0.0))).first()
    ranges = ranges or max(RANGES, -(-total // RANGE_BYTES))
    limit = max(1, min(max_shard_bytes, int(slack * total / ranges)))
    ranges = max(1, min(ranges, int(BROADCAST_BYTES / (mean_key + 16 * (len(keys) + 1)))))

    # Exponential clocks: those that ring in time, at a rate of their bytes, are a sample without replacement in which chances follow the bytes.
    u = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 1) / float(2**48 + 1)
    points = _quantiles(slim.where((F.col("b") > 0) & (-F.log(u) / F.col("b") <= ranges * oversample / max(total, 1))).select("k"), ranges)
    split, parts, own_cuts, shard = unused(docs.columns, "split", "parts", "own_cuts", "shard")
    splitters = F.broadcast(spark.createDataFrame([(points,)], T.StructType([T.StructField(split, T.ArrayType(slim.schema["k"].dataType))])))

    ranged = slim.crossJoin(splitters).select("k", "b", _rank(split, F.col("k"), len(points)).alias("range_id"))
    sizes = ranged.groupBy("range_id").agg(F.sum("b").alias("bytes"))
    sizes = parked(sizes, "sizes")
    by_key = ranged.join(F.broadcast(sizes.where(F.col("bytes") > limit).select("range_id")), "range_id").groupBy("range_id", "k").agg(F.sum("b").alias("b"))
    running = by_key.withColumn("sub", F.expr(f"floor((sum(b) OVER (PARTITION BY range_id ORDER BY k ROWS UNBOUNDED PRECEDING) - b) / {limit})"))
    cuts = running.groupBy("range_id", "sub").agg(F.min("k").alias("k")).where("sub > 0").groupBy("range_id").agg(F.sort_array(F.collect_list("k")).alias(own_cuts))
    cuts = parked(cuts, "cuts")
    most, held = cuts.agg(F.coalesce(F.max(F.size(own_cuts)), F.lit(0)), F.coalesce(F.sum(F.size(own_cuts)), F.lit(0))).first()

    # the shards in order, and so their numbers: each range has one more than it has cuts
    counted = sizes.select("range_id").join(cuts.select("range_id", F.size(own_cuts).alias("extra")), "range_id", "left").orderBy("range_id").collect()
    starts, n = [], 0
    for r in counted:
        starts.append((r["range_id"], n))
        n += 1 + (r["extra"] or 0)
    numbers = F.broadcast(spark.createDataFrame(starts, f"range_id int, {parts} int"))
    side = F.broadcast(cuts) if held * (mean_key + 16 * (len(keys) + 1)) <= BROADCAST_BYTES else cuts

    placed = docs.crossJoin(splitters).withColumn("range_id", _rank(split, key, len(points))).drop(split).join(side, "range_id", "left").withColumn("sub_id", _rank(own_cuts, key, most)).join(numbers, "range_id")
    placed = placed.select(*map(quoted, docs.columns), "range_id", "sub_id", (F.col(parts) + F.col("sub_id")).alias(shard))
    return placed.repartitionById(max(1, n), shard).drop(shard).sortWithinPartitions("range_id", "sub_id", *map(quoted, keys))


def _quantiles(keys: DataFrame, ranges: int) -> list:
    """The distinct ones of ranges - 1 quantiles of the column k. Only they come to the driver."""
    held = parked(keys, "sample")
    n = held.count()
    wanted = sorted({i * n // ranges for i in range(1, ranges)}) if n else []
    if not wanted:
        return []
    placed = parked(held.repartitionByRange(max(1, n // 100_000), "k").sortWithinPartitions("k").select("k", F.monotonically_increasing_id().alias("at")), "sample-sorted")
    # the upper bits of a row's number are its partition, in key order; the lower ones count within it
    before, offsets = 0, []
    for part, rows in sorted(tuple(r) for r in placed.groupBy(F.shiftright("at", 33).alias("part")).count().collect()):
        offsets.append((part, before))
        before += rows

    base = F.broadcast(keys.sparkSession.createDataFrame(offsets, "part long, base long"))
    places = F.broadcast(keys.sparkSession.createDataFrame([(w,) for w in wanted], "place long"))
    place = (F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place")
    found = placed.withColumn("part", F.shiftright("at", 33)).join(base, "part").select("k", place).join(places, "place")
    return list(dict.fromkeys(r["k"] for r in found.orderBy("k").collect()))
