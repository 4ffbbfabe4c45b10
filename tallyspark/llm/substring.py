"""Substring deduplication by suffix automata of reference shards.

Streaming every document past the automata of the whole corpus would cost the square of its size, so documents
are routed: of each text, winnowed hashes of GRAM words are taken so densely that any run of MIN_WORDS words
holds one at least. Documents that share a hash meet in the shard named after the first document that has it,
each with the words around the shared places, as far as a common run of MIN_WORDS words could reach. In a shard the documents pass
in the order of their ids: each is streamed through the suffix automaton of what came before, which gives the
longest match that ends at each word (matching statistics). Of its own words those stretches are then added that hold a run of MIN_WORDS
words which wasn't there, so the automaton grows with what is new alone, and a segment that an earlier document has as a whole is known by its digest and
isn't streamed. Runs of MIN_WORDS words and more that an earlier document has are the spans to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as N
from .shared import pick, quoted, schema_with, unused

MIN_WORDS = 50
GRAM = 25


class Automaton:
    """Suffix automaton of several word sequences, extended one at a time."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, sequence: list[int]) -> None:
        nexts, link, size = self.next, self.link, self.size
        last = 0
        for c in sequence:
            q = nexts[last].get(c)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, q, c)
                continue
            new = len(size)
            nexts.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, q, c)
            last = new

    def _split(self, p: int, q: int, c: int) -> int:
        nexts, link, size = self.next, self.link, self.size
        clone = len(size)
        nexts.append(dict(nexts[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = clone
            p = link[p]
        return clone

    def matches(self, sequence: list[int]) -> list[int]:
        """Of each place, the length of the longest run that ends there and occurs in what was added."""
        nexts, link, size = self.next, self.link, self.size
        at = length = 0
        out = []
        for c in sequence:
            here = nexts[at]
            while c not in here and at:
                at = link[at]
                length = size[at]
                here = nexts[at]
            if c in here:
                at = here[c]
                length += 1
            out.append(length)
        return out


def winnow(w: N.Words, gram: int, window: int) -> np.ndarray:
    """Places of the gram-word hashes that are least in some window of `window` neighbouring ones of their text, and the hashes of all places."""
    h = N.grams(w.hashes, gram)
    if not len(h):
        return np.zeros(0, np.int64), h
    last = np.repeat(w.first[1:], np.diff(w.first))[: len(h)]
    place = np.arange(len(h))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.where(place + gram <= last, h, top)
    least, k = low, 1
    while k < window:
        step = min(k, window - k)
        least = np.minimum(least, np.append(least[step:], np.full(min(step, len(least)), top)))
        k += step
    least = np.where(place + window + gram - 1 <= last, least, 0)
    most, k = least, 1
    while k < window:
        step = min(k, window - k)
        most = np.maximum(most, np.concatenate([np.zeros(min(step, len(most)), np.uint64), most[:-step]]))
        k += step
    return np.flatnonzero((most == low) & (place + gram <= last) & (most > 0)), h


def _fingerprints(docs: DataFrame, gram: int, min_words: int) -> DataFrame:
    """(doc_id, fp, low, high): winnowed hashes of each text, with their first and last places."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in N.pieces(batches):
            data, offsets = N.utf8(batch.column(1))
            for i, j in N.steps(offsets):
                w = N.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, h = winnow(w, gram, min_words - gram + 1)
                if not len(at):
                    continue
                doc, fp = w.doc[at], h[at]
                order = np.argsort(N.mix(fp + doc.astype(np.uint64)), kind="stable")
                d, f, a = doc[order], fp[order], (at - w.first[doc])[order]
                new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (f[1:] != f[:-1])))
                ids = batch.column(0).take(pa.array(i + d[new])).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(f[new].view(np.int64)), pa.array(np.minimum.reduceat(a, new).astype(np.int32)), pa.array(np.maximum.reduceat(a, new).astype(np.int32))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, fp long, low int, high int")


def _news(length: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Of a sequence with these matching statistics, the stretches made of runs of min_words words that have no match."""
    begin = np.flatnonzero(length[min_words - 1 :] < min_words)
    return _union(begin, begin + min_words)


def _union(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(low.tolist(), high.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, n_words): the maximal runs of words, unions of runs of min_words or more that a document with a smaller id has too.

    Words are compared in lower case without punctuation and counted from 0. The first document, by id, keeps
    a passage. Repeats within one document do not count; rows with the same id are taken for the same document, and their spans
    are united; a row with a null id is left out. Null, empty and shorter texts have no spans, an empty table gives none; texts count whole, however
    long. Ids are whole numbers; other columns are ignored.
    """
    spark, slim = docs.sparkSession, pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    shared = _fingerprints(slim, gram, min_words).selectExpr("*", "min(doc_id) OVER (PARTITION BY fp) AS shard", "max(doc_id) OVER (PARTITION BY fp) AS other").where("shard < other")
    places = shared.groupBy("doc_id", "shard").agg(F.collect_list(F.struct("low", "high")).alias("at"))
    places = places.groupBy("doc_id").agg(F.collect_list(F.struct("shard", "at")).alias("shards"))
    reach = min_words - gram

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in N.pieces(batches):
            data, offsets = N.utf8(batch.column(1))
            ids, shards = batch.column(0).to_pylist(), batch.column(2)
            for i, j in N.steps(offsets):
                w = N.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows: list[list] = [[], [], [], []]
                for d in range(i, j):
                    a, n = int(w.first[d - i]), int(w.first[d - i + 1] - w.first[d - i])
                    for s in shards[d]:
                        at = s["at"].values
                        low = at.field("low").to_numpy() - reach
                        high = at.field("high").to_numpy() + gram + reach
                        for p, q in _union(np.maximum(low, 0), np.minimum(high, n)):
                            for column, x in zip(rows, (s["shard"].as_py(), ids[d], p, w.hashes[a + p : a + q].tobytes())):
                                column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.binary())], names=["shard", "doc_id", "start", "words"])

    segments = slim.join(places, "doc_id").select("doc_id", "text", "shards").mapInArrow(cut, "shard long, doc_id long, start int, words binary")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton, seen, waiting, whole = None, None, None, [], {}
        for batch in batches:
            found: list[list[int]] = [[], [], []]
            for shard, doc, start, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if len(blob) < 8 * min_words:
                    continue
                if shard != now:
                    now, automaton, seen, waiting, whole = shard, Automaton(), doc, [], {}
                if doc != seen:
                    for own in waiting:
                        automaton.add(own)
                    seen, waiting = doc, []
                if whole.setdefault(hashlib.blake2b(blob, digest_size=16).digest(), doc) != doc:
                    spans = [(0, len(blob) // 8)]
                else:
                    own = np.frombuffer(blob, np.uint64).tolist()
                    length = np.array(automaton.matches(own))
                    end = np.flatnonzero(length >= min_words)
                    waiting += [own[p:q] for p, q in _news(length, min_words)]
                    spans = _union(end + 1 - length[end], end + 1)
                for p, q in spans:
                    for column, x in zip(found, (doc, start + p, start + q)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], names=["doc_id", "low", "high"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = segments.repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "start").mapInArrow(stream, "doc_id long, low long, high long")
    w = "PARTITION BY doc_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    spans = spans.selectExpr("*", f"CASE WHEN low <= max(high) OVER ({w}) THEN 0 ELSE 1 END AS fresh")
    spans = spans.selectExpr("*", "sum(fresh) OVER (PARTITION BY doc_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS part")
    return spans.groupBy("doc_id", "part").agg(F.min("low").alias("start_word"), (F.max("high") - F.min("low")).alias("n_words")).drop("part")


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the spans (doc_id, start_word, n_words) cut out of their texts, from first to last word, and n_chars recounted.

    All rows and columns stay, whatever their names; every row of an id loses the id's spans, a row with a null id none. A null or empty text, however long, or
    one without spans stays as it is; overlapping and repeated spans count once, words past a text's end are ignored. An empty table of either kind changes nothing.
    """
    span_id, cuts = unused(docs.columns, "span_id", "cuts")
    per = spans.groupBy(F.col("doc_id").alias(span_id)).agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias(cuts))
    joined = docs.join(per, quoted(id_col) == F.col(span_id), "left").drop(span_id)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans_of = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for r, (text, cut) in enumerate(zip(texts, spans_of)):
                if cut and text:
                    raw = text.encode()
                    w = N.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    out, done = [], 0
                    for s in cut:
                        a, b = s["start_word"], min(s["start_word"] + s["n_words"], len(w.hashes))
                        if a < b and w.end[b - 1] > done:
                            out.append(raw[done : max(done, int(w.start[a]))])
                            done = int(w.end[b - 1])
                    texts[r] = b"".join([*out, raw[done:]]).decode()
            columns = [pa.array(texts, c.type) if k == at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = joined.mapInArrow(run, schema_with(docs))
    if n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.when(quoted(text_col).isNotNull(), F.length(quoted(text_col)).cast(docs.schema[n_chars_col].dataType)).otherwise(quoted(n_chars_col)))
    return out
