"""A content-addressed store of token ids.

Rolling hashes over WINDOW ids cut a document's stream of ids where they hit a pattern, so equal stretches are cut
alike wherever they stand. Chunks are named by a BLAKE2b digest of their ids; equal chunks meet
in one shuffle, where each digest's ids are stored once, beside the references of which recipes consist. The manifest has each
document's Merkle root, taken when it was cut. Verification recomputes the digest of every stored chunk, the presence of every reference and every root,
which proves each document's reconstruction without moving its ids again; reconstruct() does move them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as N
from .shared import pick, scratch_path
from .tokens import VOCABULARY, encoder, ids

#: Ids that the rolling hash covers; a cut comes once in MEAN ids on average, and after LONGEST ids at the latest.
WINDOW, MEAN, LONGEST = 16, 256, 1024

#: Ids that one vectorised step handles.
_STEP = 1 << 20

_CHUNK = "doc_key long, doc_id long, n_chunks int, seq int, digest binary, n_ids long, ids binary, root binary"
_NAMES = ["doc_key", "doc_id", "n_chunks", "seq", "digest", "n_ids", "ids", "root"]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]


def cuts(stream: np.ndarray, edges: np.ndarray, window: int = WINDOW, mean: int = MEAN, longest: int = LONGEST) -> np.ndarray:
    """Ends of the chunks of streams that lie in a row, from edges[k] to edges[k + 1]: their own ends, where the hash of the last `window` ids of one
    is 0 modulo `mean`, and every `longest` ids in between."""
    own = np.unique(edges[1:][edges[1:] > edges[:-1]])
    if not len(own):
        return own
    h = N.grams(N.mix(stream.astype(np.uint64) + np.uint64(1)), window)
    hit = np.flatnonzero(h % np.uint64(mean) == 0)
    inside = np.searchsorted(own, hit, "right") == np.searchsorted(own, hit + window - 1, "right")
    ends = np.union1d(hit[inside] + window, own)
    begin = np.append(0, ends[:-1])
    extra = np.maximum(0, -(-(ends - begin) // longest) - 1)
    inner = np.repeat(begin - (np.cumsum(extra) - extra) * longest, extra) + (np.arange(extra.sum()) + 1) * longest
    return np.sort(np.append(ends, inner))


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; a last odd node moves up as it is. Leaves and inner nodes are hashed apart."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def _chunks(keys: list, docs: list, texts: list, streams: list[np.ndarray], here: set[bytes], how: tuple[int, int, int]) -> pa.RecordBatch:
    """Rows of the chunks of some documents; the ids of a chunk that this task has given before are left out."""
    edges = np.cumsum([0, *map(len, streams)])
    every = np.concatenate(streams)
    ends = cuts(every, edges, *how)
    begins = np.append(0, ends[:-1])
    raw, size = every.tobytes(), every.itemsize
    parts = [raw[a:b] for a, b in zip((begins * size).tolist(), (ends * size).tolist())]
    names = [digest(x) for x in parts]
    bodies = []
    for name, part in zip(names, parts):
        bodies.append(None if name in here else part)
        here.add(name)
    at = np.searchsorted(ends, edges, "right")
    n = np.diff(at)
    rows: list[list] = [[] for _ in _NAMES]
    for key, doc, text, first, k in zip(keys, docs, texts, at.tolist(), n.tolist()):
        mine = names[first : first + k]
        root = merkle(mine)
        one = max(k, 1)
        rows[0] += [key] * one
        rows[1] += [doc] * one
        rows[2] += [k if text is not None else -1] * one
        rows[3] += range(k) if k else [-1]
        rows[4] += mine or [None]
        rows[5] += (ends[first : first + k] - begins[first : first + k]).tolist() or [0]
        rows[6] += bodies[first : first + k] or [None]
        rows[7] += [root] + [None] * (one - 1)
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, _KINDS)], names=_NAMES)


def save(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = VOCABULARY, window: int = WINDOW, mean: int = MEAN, longest: int = LONGEST) -> None:
    """Writes folder/store in one pass, by kind: chunk (digest, ids; each digest once), reference (doc_key, seq, digest), manifest (doc_key, root).

    Ids are stored in two little-endian bytes each where the vocabulary has at most 65536, else in four. doc_key numbers the rows, since ids may be null or repeat. A null
    text is kept as null, n_chunks -1, beside an empty one, n_chunks 0: both have a reference of seq -1 without a digest. Texts are cut whole, however long; repeated
    rows and equal texts share their chunks. An empty table makes an empty store. Ids are whole numbers; other columns, of whatever name, are left out.
    """
    spark = docs.sparkSession

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: set[bytes] = set()
        narrow = np.uint16 if encoder(vocabulary).n_vocab <= 1 << 16 else np.uint32
        for batch in N.pieces(batches):
            keys, docs, texts = (c.to_pylist() for c in batch.columns)
            first, streams, held = 0, [], 0
            for k, text in enumerate(texts):
                streams.append(ids(text, vocabulary).astype(narrow))
                held += len(streams[-1])
                if held >= _STEP or k + 1 == len(texts):
                    yield _chunks(keys[first : k + 1], docs[first : k + 1], texts[first : k + 1], streams, here, (window, mean, longest))
                    first, streams, held = k + 1, [], 0
            if len(here) > 1 << 20:
                here.clear()

    slim = pick(docs, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("doc_key"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chunks = slim.mapInArrow(chunk, _CHUNK)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ids meet by digest, at most one row from each task; references without ids stay spread by document, however many name the same chunk
    meeting = F.when(F.col("ids").isNotNull(), F.col("digest")).otherwise(F.col("doc_key").cast("string").cast("binary"))
    met = chunks.repartition(n, meeting).sortWithinPartitions(F.asc_nulls_last("digest"), F.col("ids").isNull())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            names = batch["digest"]
            if not batch.num_rows:
                continue
            fresh = pa.concat_arrays([pa.array([names[0].as_py() != last]), pc.fill_null(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)), False)])
            last = names[len(names) - 1].as_py()
            for kind, kept, columns in (("chunk", pc.and_(fresh, pc.is_valid(batch["ids"])), {"digest", "n_ids", "ids"}), ("reference", None, {"doc_key", "doc_id", "n_chunks", "seq", "digest", "n_ids"}), ("manifest", pc.is_valid(batch["root"]), {"doc_key", "doc_id", "n_chunks", "root"})):
                rows = batch.filter(kept) if kept is not None else batch
                yield pa.RecordBatch.from_arrays([pa.array([kind] * rows.num_rows, pa.string()), *(rows[c] if c in columns else pa.nulls(rows.num_rows, k) for c, k in zip(_NAMES, _KINDS))], names=["kind", *_NAMES])

    met.mapInArrow(split, f"kind string, {_CHUNK}").write.partitionBy("kind").parquet(f"{folder}/store")


def _stored(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(f"{_CHUNK}, kind string").parquet(f"{folder}/store").where(F.col("kind") == kind).drop("kind")


def recipes(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_key, n_ids, digests, root): each document's references in order, and their Merkle root as the stored references give it."""
    listed = _stored(spark, folder, "reference").groupBy("doc_key").agg(F.sum("n_ids").alias("n_ids"), F.array_sort(F.collect_list(F.when(F.col("seq") >= 0, F.struct("seq", "digest")))).alias("digests"))

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("digests")
            names, edges = column.flatten().field("digest").to_pylist(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())]).tolist()
            roots = pa.array([merkle(names[a:b]) for a, b in zip(edges, edges[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, roots], names=[*batch.schema.names, "root"])

    return listed.mapInArrow(root, "doc_key long, n_ids long, digests array<struct<seq: int, digest: binary>>, root binary")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n_ids, n_chunks, root, verified) of every document of the manifest.

    verified: the recipe has its n_chunks chunks numbered from 0, its root is the manifest's, and every chunk it names is stored, once, with ids of that
    digest and number. n_chunks is -1 for a null text, 0 for an empty one; both verify. Repeated rows have a line each; an empty store has none.
    """

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [own is not None and digest(own) == name and len(own) in (2 * n, 4 * n) for name, n, own in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["digest", "stored_ids", "good"])

    chunks = _stored(spark, folder, "chunk").select("digest", "n_ids", "ids").mapInArrow(test, "digest binary, stored_ids long, good boolean")
    chunks = chunks.groupBy("digest").agg(F.min("stored_ids").alias("stored_ids"), (F.min("good") & (F.count("*") == 1)).alias("good"))
    references = _stored(spark, folder, "reference").where("digest IS NOT NULL").select("doc_key", "digest", "n_ids")
    # each chunk that is named counts once here, by partial aggregation, so that one in very many documents burdens no task
    bad = references.select("digest", "n_ids").distinct().join(chunks, "digest", "left").where("NOT coalesce(good AND stored_ids = n_ids, false)").select("digest", "n_ids")
    lost = references.join(bad, ["digest", "n_ids"], "left_semi").select("doc_key").distinct().withColumn("lost", F.lit(True))
    manifest = _stored(spark, folder, "manifest").select("doc_key", "doc_id", "n_chunks", "root")
    again = recipes(spark, folder).select("doc_key", "n_ids", F.size("digests").alias("found"), F.expr("transform(digests, x -> x.seq) = transform(digests, (x, k) -> k)").alias("numbered"), F.col("root").alias("root_again"))
    joined = manifest.join(again, "doc_key", "left").join(lost, "doc_key", "left")
    good = F.expr("coalesce(root = root_again AND numbered AND found = greatest(n_chunks, 0), false) AND lost IS NULL")
    return joined.select("doc_id", "n_ids", "n_chunks", F.hex("root").alias("root"), good.alias("verified"))


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_key, doc_id, n_ids, ids): every document's ids put together from the store; null where its text was null."""
    references = _stored(spark, folder, "reference").select("doc_key", "doc_id", "seq", "digest", "n_chunks", "n_ids")
    parts = references.join(_stored(spark, folder, "chunk").select("digest", "ids"), "digest", "left").groupBy("doc_key").agg(F.first("doc_id").alias("doc_id"), F.max("n_chunks").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("seq", "n_ids", "ids"))).alias("parts"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [[x for p in parts if p["ids"] for x in np.frombuffer(p["ids"], np.uint16 if len(p["ids"]) == 2 * p["n_ids"] else np.uint32).tolist()] if n >= 0 else None for n, parts in zip(batch.column("n_chunks").to_pylist(), batch.column("parts").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_key"), batch.column("doc_id"), pa.array([len(x or []) for x in whole], pa.int64()), pa.array(whole, pa.list_(pa.int64()))], names=["doc_key", "doc_id", "n_ids", "ids"])

    return parts.mapInArrow(put, "doc_key long, doc_id long, n_ids long, ids array<long>")


def stored_and_verified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs saved to the scratch folder, and what verify() says of them."""
    folder = scratch_path(docs.sparkSession, "token-store")
    save(docs, folder, id_col, text_col, vocabulary=vocabulary)
    return verify(docs.sparkSession, folder)
