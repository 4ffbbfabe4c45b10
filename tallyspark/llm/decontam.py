"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of about SHARD_BYTES. Its words, with a separator after each document, are
sorted as suffixes; the Burrows-Wheeler transform of the sequence is kept as a wavelet matrix with prefix
counts, beside every SAMPLE-th suffix position and those of the documents' first words. All benchmark phrases, the windows of ngram words of each
item and shorter items whole, are searched backwards together by wavelet ranks, those of one length at a time; the occurrences are located by walking to a sampled
position, and overlapping or touching ones are merged to removal spans.

Phrases reach the shards by broadcast up to a checked size. Beyond it the shard indexes are written to the
scratch folder once and searched with one block of phrases after another.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as N
from .shared import BROADCAST_BYTES, parked, pick, schema_with, unused
from .substring import remove_spans

NGRAM = 13
#: Items of fewer words are too common as phrases to tell a leak from ordinary language.
SHORTEST = 5
SHARD_BYTES = 2 << 20
SAMPLE = 16


class FMIndex:
    """Full-text index of word hashes of consecutive documents; see the module."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, sample: int = SAMPLE):
        n_docs = len(first) - 1
        self.vocabulary, symbols = N.dense(hashes)
        text = np.zeros(len(hashes) + n_docs, np.int64)
        doc = np.repeat(np.arange(n_docs), np.diff(first))
        text[np.arange(len(hashes)) + doc] = symbols + 1
        self.begins = first[:-1] + np.arange(n_docs)
        self.n = n = len(text)
        sa = N.suffix_array(N.suffix_ranks(text, keep_all=False)[-1][1])
        counts = np.bincount(text, minlength=len(self.vocabulary) + 1) if n else np.zeros(1, np.int64)
        self.below = np.cumsum(counts) - counts
        # a document's first word is sampled too, so no walk steps over a separator, where the order of rows isn't kept
        marked = (sa % sample == 0) | (text[sa - 1] == 0)
        self.marks = np.append(0, np.cumsum(marked)).astype(np.int32)
        self.samples = sa[marked].astype(np.int32)
        self.bwt = text[sa - 1].astype(np.int32)
        x, self.zeros, self.ranks = self.bwt, [], []
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        for level in reversed(range(self.bits)):
            off = (x >> level) & 1 == 0
            self.ranks.append(np.append(0, np.cumsum(off)).astype(np.int32))
            self.zeros.append(int(self.ranks[-1][-1]))
            x = np.concatenate([x[off], x[~off]])

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows before `at` whose last word is `symbol`, added to the rows of smaller symbols: a step of backward search."""
        start = np.zeros_like(at)
        for level, zeros, rank in zip(reversed(range(self.bits)), self.zeros, self.ranks):
            one = (symbol >> level) & 1 == 1
            a, s = rank[at], rank[start]
            at, start = np.where(one, zeros + at - a, a), np.where(one, zeros + start - s, s)
        return self.below[symbol] + at - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place) of every occurrence of the rows of `phrases`, hashes of equally many words."""
        wide, alive = phrases.shape[1], np.arange(len(phrases))
        if not self.n or not len(phrases) or not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = np.minimum(np.searchsorted(self.vocabulary, phrases), len(self.vocabulary) - 1)
        alive = np.flatnonzero((self.vocabulary[where] == phrases).all(axis=1))
        symbols = where + 1
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n)
        for k in reversed(range(wide)):
            c = symbols[alive, k]
            low, high = self.follow(c, low), self.follow(c, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        many = high - low
        row = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(alive, many), self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes of these rows, by steps back to a sampled one."""
        place, left, back = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(left):
            hit = self.marks[row + 1] > self.marks[row]
            place[left[hit]] = self.samples[self.marks[row[hit]]] + back
            left, row, back = left[~hit], row[~hit], back + 1
            row = self.follow(self.bwt[row].astype(np.int64), row)
        return place % max(self.n, 1)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vocabulary=self.vocabulary, begins=self.begins, below=self.below, marks=self.marks, samples=self.samples, bwt=self.bwt, zeros=np.array(self.zeros), ranks=np.stack(self.ranks))
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> FMIndex:
        self, x = cls.__new__(cls), np.load(io.BytesIO(blob))
        for name in ("vocabulary", "begins", "below", "marks", "samples", "bwt"):
            setattr(self, name, x[name])
        self.zeros, self.ranks, self.n = x["zeros"].tolist(), list(x["ranks"]), len(self.bwt)
        self.bits = len(self.ranks)
        return self


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document with overlapping and touching ones united, and for each given span its united one's number."""
    order = np.lexsort((end, start, doc))
    d, s = doc[order], start[order]
    far = (d.astype(np.int64) << 40) + end[order]
    reach = np.maximum.accumulate(far) if len(far) else far
    new = np.append(True, (d << 40)[1:] + s[1:] > reach[:-1]) if len(d) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    last = np.append(np.flatnonzero(new)[1:], len(d)) - 1 if len(d) else np.zeros(0, np.int64)
    of = np.empty(len(d), np.int64)
    of[order] = group
    return d[new], s[new], (reach[last] - (d[new] << 40)) if len(d) else s, of


#: Phrases of one length, a row of word hashes each, and the item of each.
Phrases = list[tuple[np.ndarray, np.ndarray]]


def shard_spans(index: FMIndex, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(document, first word, words, items) of each removal span in one shard."""
    found = [np.zeros((3, 0), np.int64)]
    for grams, items in phrases:
        phrase, place = index.search(grams)
        found.append(np.stack([place, place + grams.shape[1], items[phrase]]))
    place, end, item = np.concatenate(found, axis=1)
    doc = np.searchsorted(index.begins, place, "right") - 1
    d, s, e, of = merged(doc, place - index.begins[doc], end - index.begins[doc])
    pairs = np.unique(np.stack([of, item]), axis=1)
    ids = np.split(pairs[1], np.searchsorted(pairs[0], np.arange(1, len(d)))) if len(d) else []
    return d, s, e - s, ids


def phrases_of(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", *, ngram: int = NGRAM, shortest: int = SHORTEST) -> DataFrame:
    """(item_id, gram): every window of ngram words of every item, as 8 bytes a word. An item of fewer words, but `shortest` at least, is one phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in N.pieces(batches):
            data, offsets = N.utf8(batch.column(1))
            w = N.words(data, offsets)
            items, grams = [], []
            for item, a, b in zip(batch.column(0).to_pylist(), w.first[:-1].tolist(), w.first[1:].tolist()):
                wide = min(ngram, b - a)
                own = [w.hashes[k : k + wide].tobytes() for k in range(a, b - wide + 1)] if wide >= min(shortest, ngram) else []
                grams += own
                items += [item] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(grams, pa.binary())], names=["item_id", "gram"])

    slim = pick(bench, item_id=item_col, text=text_col).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return slim.where("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "item_id long, gram binary").distinct()


def _blocks(bench: DataFrame, item_col: str, text_col: str, ngram: int, limit: int, shortest: int) -> Iterator[tuple[Phrases, bool]]:
    """Phrases, as many at a time as the limit allows, and whether these are all."""
    found = parked(phrases_of(bench, item_col, text_col, ngram=ngram, shortest=shortest), "phrases")
    n = found.count()
    blocks = max(1, -(-n * (8 * ngram + 8) // limit))
    for k in range(blocks):
        rows = found.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == k).toArrow() if blocks > 1 else found.toArrow()
        grams, items = rows["gram"].to_pylist(), rows["item_id"].to_numpy()
        wide = np.array([len(x) // 8 for x in grams], np.int64)
        by_width = [(w, np.flatnonzero(wide == w)) for w in np.unique(wide).tolist()]
        yield [(np.frombuffer(b"".join([grams[k] for k in some.tolist()]), np.uint64).reshape(-1, w), items[some]) for w, some in by_width], blocks == 1


def _shards(column: pa.Array, shard_bytes: int) -> Iterator[tuple[int, int, N.Words]]:
    data, offsets = N.utf8(column)
    for i, j in N.steps(offsets, shard_bytes):
        w = [N.words(data[offsets[a + i] : offsets[b + i]], offsets[a + i : b + i + 1] - offsets[a + i]) for a, b in N.steps(offsets[i : j + 1])]
        n = np.cumsum([0, *(len(x.hashes) for x in w)])
        shift = np.cumsum([0, *(int(offsets[b + i] - offsets[a + i]) for a, b in N.steps(offsets[i : j + 1]))])
        yield i, j, N.Words(
            np.concatenate([x.hashes for x in w]),
            np.concatenate([x.start + s for x, s in zip(w, shift)]),
            np.concatenate([x.end + s for x, s in zip(w, shift)]),
            np.append(np.concatenate([x.first[:-1] + m for x, m in zip(w, n)]), n[-1]),
        )


_SPANS = "doc_id long, start_word long, n_words long, item_ids array<long>"


def _span_batch(ids: pa.Array, d: np.ndarray, s: np.ndarray, n: np.ndarray, items: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(d)).cast(pa.int64()), pa.array(s), pa.array(n), pa.array([x.tolist() for x in items], pa.list_(pa.int64()))], names=["doc_id", "start_word", "n_words", "item_ids"])


def contaminated_spans(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, ngram: int = NGRAM, shortest: int = SHORTEST, shard_bytes: int = SHARD_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, start_word, n_words, item_ids): the maximal runs of words that phrases of the benchmark cover.

    Phrases are all windows of ngram words of an item; an item of fewer words, but `shortest` at least, is a phrase as a whole. Words are compared in lower
    case without punctuation and counted from 0. Documents that share no phrase have no row; so have null, empty and wordless texts. Every row of docs is
    searched whole, however long, repeated rows each by itself; a null id stays null. Items that are null, have a null id or fewer than `shortest` words give no
    phrase; of repeated items and phrases one counts. An empty benchmark or corpus gives an empty result. Ids are whole numbers; other columns are ignored.
    """
    spark, both = docs.sparkSession, pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    index = None
    out = []
    for phrases, alone in _blocks(bench, item_col, item_text_col, ngram, broadcast_bytes, shortest):
        sent = spark.sparkContext.broadcast(phrases)
        if alone:

            def direct(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for batch in N.pieces(batches):
                    for i, j, w in _shards(batch.column(1), shard_bytes):
                        yield _span_batch(batch.column(0).slice(i, j - i), *shard_spans(FMIndex(w.hashes, w.first), sent.value))

            return both.mapInArrow(direct, _SPANS)

        if index is None:

            def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in N.pieces(batches):
                    for i, j, w in _shards(batch.column(1), shard_bytes):
                        ids = batch.column(0).slice(i, j - i).cast(pa.int64()).to_pylist()
                        yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())), pa.array([FMIndex(w.hashes, w.first).dump()], pa.binary())], names=["shard", "ids", "fm"])

            index = parked(both.mapInArrow(build, "shard string, ids array<long>, fm binary"), "fm-index")

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, ids, fm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    d, s, n, found = shard_spans(FMIndex.load(fm.as_py()), sent.value)
                    spans = _span_batch(pa.array(ids, pa.int64()), d, s, n, found)
                    yield spans.append_column("row", pa.array([f"{shard}-{k}" for k in d.tolist()], pa.string()))

        out.append(parked(index.mapInArrow(search, f"{_SPANS}, row string"), "spans"))
    return _united(out)


def _united(parts: list[DataFrame]) -> DataFrame:
    """Spans found with different blocks of phrases, merged anew."""
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    w = "PARTITION BY row ORDER BY start_word, n_words ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    run = every.selectExpr("*", f"CASE WHEN start_word <= max(start_word + n_words) OVER ({w}) THEN 0 ELSE 1 END AS fresh")
    run = run.selectExpr("*", "sum(fresh) OVER (PARTITION BY row ORDER BY start_word, n_words ROWS UNBOUNDED PRECEDING) AS part")
    return run.groupBy("row", "part").agg(F.first("doc_id").alias("doc_id"), F.min("start_word").alias("start_word"), (F.max(F.expr("start_word + n_words")) - F.min("start_word")).alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")).drop("row", "part")


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text", *, ngram: int = NGRAM, shortest: int = SHORTEST,
    shard_bytes: int = SHARD_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with the text of every removal span of contaminated_spans() cut out, from its first to its last word, and n_chars recounted.

    All rows stay, repeated ones and those with a null id too, in all columns, whatever their names; a text that was wholly contaminated becomes empty, null, empty and
    wordless ones stay as they are. Texts are searched whole, however long. Where the benchmark is too large to broadcast, the spans of all its blocks are found
    first, and cut out by a join. An empty benchmark leaves docs as they are.
    """
    at = docs.columns.index(text_col)
    count = docs.columns.index(n_chars_col) if n_chars_col in docs.columns else None
    phrases, alone = next(_blocks(bench, item_col, item_text_col, ngram, broadcast_bytes, shortest))
    if not alone:
        (row,) = unused(docs.columns, "row")
        numbered = parked(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        spans = contaminated_spans(numbered, bench, row, text_col, item_col, item_text_col, ngram=ngram, shortest=shortest, shard_bytes=shard_bytes, broadcast_bytes=broadcast_bytes)
        return remove_spans(numbered, spans, row, text_col, n_chars_col).drop(row)
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in N.pieces(batches):
            texts, cut = batch.column(at), {}
            data, offsets = N.utf8(texts)
            for i, j, w in _shards(texts, shard_bytes):
                d, s, n, _ids = shard_spans(FMIndex(w.hashes, w.first), sent.value)
                for doc, a, b in zip(d.tolist(), w.start[w.first[d] + s].tolist(), w.end[w.first[d] + s + n - 1].tolist()):
                    cut.setdefault(i + doc, []).append((a + int(offsets[i]), b + int(offsets[i])))
            if cut:
                new = texts.to_pylist()
                for doc, spans in cut.items():
                    edges = [int(offsets[doc]), *(x for span in spans for x in span), int(offsets[doc + 1])]
                    new[doc] = b"".join(data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])).decode()
                columns = batch.columns
                columns[at] = pa.array(new, texts.type)
                if count is not None:
                    old = columns[count].to_pylist()
                    for doc in cut:
                        old[doc] = len(new[doc])
                    columns[count] = pa.array(old, batch.column(count).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(clean, schema_with(docs))
