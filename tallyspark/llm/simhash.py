"""SimHash near-duplicates through an inverted index of fingerprint bytes.

A document's fingerprint has 256 bits: each distinct word votes on every bit by its own hash, longer words
more, since short ones are common to all texts. Documents of equal fingerprints are one entry of the index.
A list for a single byte at a position would hold a 256th of the corpus, and its pairs grow with the square, so the index is
keyed by the bytes at several positions together, TABLES sets of KEY_BYTES positions: all those within GROUPS groups of positions,
and some across them. Fingerprints that share 2 * GROUPS + 1 bytes share KEY_BYTES = 3 of one group, so those up to BYTES - 9 = 23 bits apart always meet.
For the pairs that meet, the shared positional bytes are counted, and pairs with too few drop out: fingerprints within max_bits
share BYTES - max_bits at least, and all but a share LOSS of those max_bits apart have fewest_shared() or more. The rest are verified by Hamming distance.
Classes don't need all pairs: near_duplicate_classes() lets those of one list that are in one class already go, and compares inside classes without the index.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as N
from .shared import BROADCAST_BYTES, parked, pick, quoted, unused

BYTES = 32
KEY_BYTES = 3
#: Groups of byte positions; all sets of KEY_BYTES positions within one are tables. Four groups of eight make 224.
GROUPS = 4
#: Tables in all, those across groups included.
TABLES = 256
MAX_BITS = 40
#: Of the fingerprints MAX_BITS apart, the share that the count filter may lose.
LOSS = 0.005
_STEP = 1 << 17
#: Rows of a class that are held against as many others in one task.
_BLOCK = 1 << 14
#: Cells of the matrix of documents and words that is held at a time.
_CELLS = 1 << 21

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("f3", pa.int64())])
_PARTS = ["f0", "f1", "f2", "f3"]


def position_sets(tables: int = TABLES, key_bytes: int = KEY_BYTES, groups: int = GROUPS) -> list[tuple[int, ...]]:
    """Sets of byte positions: all within one group of neighbouring positions, then such across groups by lot, up to `tables` of them. Always the same for the same arguments."""
    edges = [g * BYTES // groups for g in range(groups + 1)]
    out = [x for a, b in zip(edges, edges[1:]) for x in itertools.combinations(range(a, b), key_bytes)]
    across = [x for x in itertools.combinations(range(BYTES), key_bytes) if x not in set(out)]
    random.Random(7).shuffle(across)
    return [*out, *across][: max(tables, len(out))]


def fewest_shared(max_bits: int = MAX_BITS, loss: float = LOSS) -> int:
    """The number of positional bytes that fingerprints max_bits apart share: by the pigeonhole principle, or, where that is more, all but `loss` of them if the bits are anywhere alike."""
    ways, total, below, m = math.comb(8 * BYTES, max_bits), 0, 0, 0
    for m in range(BYTES + 1):
        total = math.comb(BYTES, m) * sum((-1) ** j * math.comb(BYTES - m, j) * math.comb(8 * (BYTES - m - j), max_bits) for j in range(BYTES - m + 1))
        if below + total > loss * ways:
            break
        below += total
    return max(BYTES - max_bits, m)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text as four 64-bit numbers. A wordless one is a hash of its bytes without outer white space."""
    w, n = N.words(data, offsets), len(offsets) - 1
    prints = np.zeros((n, BYTES), np.uint8)
    for d in np.flatnonzero(np.diff(w.first) == 0):
        bare = data[offsets[d] : offsets[d + 1]].tobytes().strip()
        prints[d] = np.frombuffer(hashlib.blake2b(bare, digest_size=BYTES).digest(), np.uint8)
    if not len(w.hashes):
        return prints.view(np.uint64)
    doc = w.doc
    order = np.argsort(N.mix(w.hashes + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    d, h, size = doc[order], w.hashes[order], (w.end - w.start)[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
    d, h, size = d[new], h[new], size[new]
    vocabulary, index = N.dense(h)
    weight = np.where(size <= 3, 1, np.where(size == 4, 4, 10)).astype(np.float32)
    signs = np.unpackbits(np.stack([N.mix(vocabulary + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(1, 5)], axis=1).view(np.uint8), axis=1).astype(np.float32) - np.float32(0.5)
    rows = max(1, _CELLS // len(vocabulary))
    order = np.argsort(d, kind="stable")
    edge = np.searchsorted(d[order], np.arange(0, n + rows, rows))
    for k, a in enumerate(range(0, n, rows)):
        some = order[edge[k] : edge[k + 1]]
        votes = np.zeros((min(rows, n - a), len(vocabulary)), np.float32)
        votes[d[some] - a, index[some]] = weight[some]
        worded = np.diff(w.first[a : min(a + rows, n) + 1]) > 0
        prints[a : a + rows][worded] = np.packbits(votes[worded] @ signs > 0, axis=1)
    return prints.view(np.uint64)


def simhashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0, f1, f2, f3) of every document that has an id and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in N.pieces(batches):
            data, offsets = N.utf8(batch.column(1))
            for i, j in N.steps(offsets, _STEP):
                prints = fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), *(pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(4))], schema=_SCHEMA)

    slim = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "doc_id long, f0 long, f1 long, f2 long, f3 long")


def _entries(prints: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(doc_id, key) for each fingerprint and set. Built in numpy, since hundreds of sets as columns fill the driver's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                some = batch.slice(a, 1000)
                parts = np.stack([some.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5)], axis=1)
                at = np.ascontiguousarray(parts).view(np.uint8).astype(np.int64)[:, np.array(sets)]
                keys = (at << 8 * np.arange(at.shape[2])).sum(axis=2) + (np.arange(len(sets)) << 8 * at.shape[2])
                ids = np.repeat(some.column(0).to_numpy(zero_copy_only=False), len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel())], names=["doc_id", "key"])

    return prints.select("doc_id", *_PARTS).mapInArrow(run, "doc_id long, key long")


def _verified(met: DataFrame, firsts: DataFrame, max_bits: int) -> DataFrame:
    """Of distinct pairs (doc_a, doc_b, ...), those at most max_bits apart, and hamming. An id of several rows in firsts may give a pair several times."""
    # only the two ids of a pair move; the fingerprints, and with them the tally of shared bytes, are fetched for distinct pairs
    left, right = (firsts.select(F.col("doc_id").alias(f"doc_{x}"), *[F.col(p).alias(f"{x}{p}") for p in _PARTS]) for x in "ab")
    both = met.join(left, "doc_a").join(right, "doc_b")
    xors = [F.col(f"a{p}").bitwiseXOR(F.col(f"b{p}")) for p in _PARTS]
    apart = sum((F.bit_count(x) for x in xors), F.lit(0))
    shared = sum((F.expr(f"CASE WHEN shiftrightunsigned(a{p} ^ b{p}, {8 * k}) & 255 = 0 THEN 1 ELSE 0 END") for p in _PARTS for k in range(8)), F.lit(0))
    return both.where((shared >= fewest_shared(max_bits)) & (apart <= max_bits)).select(*met.columns, apart.alias("hamming"))


def _with_heads(entries: DataFrame) -> DataFrame:
    """(key, head, doc_id) of all entries but the first of each list, whose least id is head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = head = -1  # keys aren't negative
        for batch in batches:
            if batch.num_rows:
                key, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
                at = np.maximum.accumulate(np.where(np.append(key[0] != last, key[1:] != key[:-1]), np.arange(len(key)), -1))
                heads = np.where(at < 0, head, doc[at])
                last, head, new = key[-1], heads[-1], doc > heads
                yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (key, heads, doc)], names=["key", "head", "doc_id"])

    lists = entries.select("key", "doc_id").repartition("key").sortWithinPartitions("key", "doc_id")
    return lists.mapInArrow(run, "key long, head long, doc_id long")


def _classes(firsts: DataFrame, max_bits: int, tables: int, key_bytes: int) -> DataFrame:
    """(doc_id, class_id) of every id that has a link: what groups() makes of all pairs that meet in the index.

    Of near copies, all pairs of a list would be the square of its length. So each list first gives the pairs with its head; of the others, only those are
    still open whose ids aren't in one class by then.
    """
    lists = parked(_with_heads(_entries(firsts, position_sets(tables, key_bytes))), "lists")
    stars = _verified(lists.select(F.col("head").alias("doc_a"), F.col("doc_id").alias("doc_b")).distinct(), firsts, max_bits)
    begun = parked(groups(parked(stars.select("doc_a", "doc_b").distinct(), "links")), "classes")
    listed = parked(lists.join(begun, "doc_id", "left").selectExpr("key", "doc_id", "coalesce(group_id, doc_id) AS kind"), "listed")
    kinds = listed.select("key", "kind").distinct()
    mixed = kinds.selectExpr("key", "kind AS kind_a").join(kinds.selectExpr("key", "kind AS kind_b"), "key").where("kind_a < kind_b")
    a, b = (listed.selectExpr("key", f"kind AS kind_{x}", f"doc_id AS {x}") for x in "ab")
    met = mixed.join(a, ["key", "kind_a"]).join(b, ["key", "kind_b"]).selectExpr("least(a, b) AS doc_a", "greatest(a, b) AS doc_b", "kind_a", "kind_b").where("doc_a < doc_b").distinct()
    later = groups(parked(_verified(met, firsts, max_bits).selectExpr("kind_a AS doc_a", "kind_b AS doc_b").distinct(), "links"))
    begun = begun.unionByName(later.selectExpr("doc_id", "doc_id AS group_id").join(begun, "doc_id", "left_anti"))
    return begun.join(later.selectExpr("doc_id AS group_id", "group_id AS class_id"), "group_id", "left").selectExpr("doc_id", "coalesce(class_id, group_id) AS class_id")


def _links(members: DataFrame, max_bits: int) -> DataFrame:
    """(doc_id, others) from (class_id, doc_id, copies, f0, f1, f2, f3): the copies of all other ids of its class that are at most max_bits from one of its rows.

    Every pair of a class is compared, in blocks of rows against blocks.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        column = {n: table[n].to_numpy() for n in table.column_names}
        low, high = column["low"][0], column["high"][0]

        def side(block: int) -> tuple[np.ndarray, ...]:
            mine = column["own"] == block
            ids, starts = np.unique(column["doc_id"][mine], return_index=True)
            return ids, starts, column["copies"][mine][starts].astype(np.float64), np.stack([column[p][mine] for p in _PARTS]).view(np.uint64)

        (ids, starts, copies, prints), (ids_y, starts_y, copies_y, prints_y) = side(low), side(high)
        found, found_y = np.zeros(len(ids)), np.zeros(len(ids_y))
        for i in range(0, len(ids) if len(ids_y) else 0, 64):
            j = min(i + 64, len(ids))
            x = prints[:, starts[i] : starts[j] if j < len(ids) else None]
            near = sum(np.bitwise_count(p[:, None] ^ q[None, :]).astype(np.int16) for p, q in zip(x, prints_y)) <= max_bits
            near = np.logical_or.reduceat(np.logical_or.reduceat(near, starts_y, axis=1), starts[i:j] - starts[i], axis=0) if near.shape != (j - i, len(ids_y)) else near
            near = (near & (ids[i:j, None] != ids_y[None, :])).astype(np.float64)
            found[i:j] = near @ copies_y
            found_y += copies[i:j] @ near
        both = low != high
        return pa.table({"doc_id": np.append(ids, ids_y) if both else ids, "others": (np.append(found, found_y) if both else found).astype(np.int64)})

    blocks = members.groupBy("class_id").agg(F.expr(f"int(ceil(count(*) / {_BLOCK}))").alias("blocks"))
    rows = members.join(blocks, "class_id").selectExpr("*", "pmod(xxhash64(doc_id), blocks) AS own").selectExpr("*", "explode(sequence(0, blocks - 1)) AS other")
    rows = rows.selectExpr("class_id", "least(own, other) AS low", "greatest(own, other) AS high", "own", "doc_id", "copies", *_PARTS)
    # a number that is given keeps these few bytes from being merged into one task
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "class_id", "low", "high")
    return rows.groupBy("class_id", "low", "high").applyInArrow(run, "doc_id long, others long").groupBy("doc_id").agg(F.sum("others").alias("others"))


def near_duplicate_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_bits: int = MAX_BITS, tables: int = TABLES, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(doc_a, doc_b, hamming), doc_a < doc_b, once each: pairs of documents with fingerprints at most max_bits apart.

    Among documents of equal fingerprints, only the pairs with the one of least id, their first, are given; pairs between
    different fingerprints are given for their first documents. Every document thus hangs on its group by a
    chain of pairs. With the default tables all pairs up to 23 bits apart are found. Beyond that the search misses pairs that share none of the tables' keys, and the count
    filter a few; see the README for its recall.
    Texts without words, the empty one among them, are alike only where they are equal but for outer white space. Texts count whole, however long. Null texts, and rows
    with a null id, have no pairs, nor has an empty table. Rows with one id count as one
    document: it pairs with others by each of its texts, never with itself. Ids are whole numbers; other columns are ignored.
    """
    prints = simhashes(docs, id_col, text_col).selectExpr("*", f"min(doc_id) OVER (PARTITION BY {', '.join(_PARTS)}) AS first")
    prints = parked(prints, "simhash")
    same = prints.where("first < doc_id").selectExpr("first AS doc_a", "doc_id AS doc_b", "0 AS hamming")
    firsts = prints.where("first = doc_id").drop("first")
    entries = _entries(firsts, position_sets(tables, key_bytes))
    a, b = entries.alias("a"), entries.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.doc_id") < F.col("b.doc_id"))).select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b")).distinct()
    near = _verified(met, firsts, max_bits)
    return same.unionByName(near).groupBy("doc_a", "doc_b").agg(F.min("hamming").cast("int").alias("hamming"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_bits: int = MAX_BITS, tables: int = TABLES, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(doc_id, class_id, links), one row for each id: the least id of the connected component, and how many other documents are within max_bits.

    Classes are the components of near_duplicate_pairs(), without its pairs: documents of equal fingerprints are searched as one and counted as many, and rows
    grow with the documents. Links are counted by comparing all of a class, so those inside are all there, whether they meet in the index or not; only links between classes
    that the index doesn't join are missed. A document without links is a class of its own, one with a null text too; rows with a null id have no row.
    Rows with one id count as one document: it links by each of its texts, once to each other document, never to itself. Empty, wordless and long texts, ids and other columns
    are as in near_duplicate_pairs(); an empty table gives an empty one.
    """
    ids = pick(docs, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL AND text IS NULL").select(F.col("doc_id").cast("long"), *[F.lit(None).cast("long").alias(p) for p in _PARTS])
    texts = simhashes(docs, id_col, text_col).unionByName(ids).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.when(F.col("f0").isNotNull(), F.struct(*_PARTS)))).alias("prints"))
    # documents with the same fingerprints are copies; those without any aren't
    alike = "OVER (PARTITION BY prints, IF(size(prints) = 0, doc_id, NULL))"
    texts = parked(texts.selectExpr("*", f"min(doc_id) {alike} AS first", f"count(*) {alike} AS copies"), "simhash")
    firsts = texts.where("first = doc_id").selectExpr("doc_id", "copies", "inline(prints)")
    classes = parked(_classes(firsts.drop("copies"), max_bits, tables, key_bytes), "classes")
    classes = classes.join(_links(firsts.join(classes, "doc_id"), max_bits), "doc_id").withColumnRenamed("doc_id", "first")
    return texts.join(classes, "first", "left").selectExpr("doc_id", "coalesce(class_id, first) AS class_id", "copies - 1 + coalesce(others, 0) AS links")


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every document in a pair (doc_a, doc_b): the least id of its connected component.

    Least labels travel along the pairs, and labels point on to their own labels, until nothing changes; each
    round is written to the scratch folder, so no lineage grows.
    """
    edges = parked(pairs.selectExpr("doc_a AS x", "doc_b AS y").unionByName(pairs.selectExpr("doc_b AS x", "doc_a AS y")), "edges")
    labels = parked(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels")
    while True:
        near = edges.join(labels.selectExpr("x AS y", "label AS other"), "y").groupBy("x").agg(F.min("other").alias("other"))
        step = labels.join(near, "x").select("x", F.least("label", "other").alias("new"), "label")
        jump = step.join(labels.selectExpr("x AS new", "label AS far"), "new", "left")
        new = parked(jump.select("x", F.coalesce(F.least("new", "far"), "new").alias("label"), F.col("label").alias("old")), "labels")
        if new.where("label <> old").isEmpty():
            return new.selectExpr("x AS doc_id", "label AS group_id")
        labels = new.drop("old")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """docs without the members of near-duplicate groups other than the one of least id.

    Groups are the connected components of near_duplicate_pairs(). Documents without pairs all stay, those with null ids or texts too; empty texts are copies of each
    other. Of rows that share an id all stay or all go. Texts count whole, however long; all columns stay, whatever their names; an empty table gives an empty one.
    """
    (gone_id,) = unused(docs.columns, "gone_id")
    gone = groups(near_duplicate_pairs(docs, id_col, text_col, **how)).where("group_id < doc_id").select(F.col("doc_id").alias(gone_id))
    # texts move only where the ids to drop, 16 bytes each, are too many to broadcast
    gone = F.broadcast(gone) if gone.count() * 16 <= BROADCAST_BYTES else gone
    return docs.join(gone, quoted(id_col) == F.col(gone_id), "left_anti")
