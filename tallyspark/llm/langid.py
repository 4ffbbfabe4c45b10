"""Language identification by hyperdimensional profiles.

Each letter has a random vector of DIM signs, drawn from its code point alone. An n-gram's vector binds its letters'
vectors, each permuted by its place (a cyclic shift), by multiplication; a text's vector bundles those
of all its n-grams by addition. A language's prototype bundles the texts of a bounded sample of labelled rows,
each scaled to length 1. A document gets the language of the prototype with the largest cosine, and is rejected where
that is under the limit for its number of n-grams, or where it has no letters. One rule makes the limits for all numbers: what all
but LOW_SHARE of the sampled texts reach when cut to so many n-grams, but no less than CHANCE standard deviations of
the cosine with a random vector, 1 / sqrt(DIM) each, and no more than MIN_COSINE.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as N
from .shared import BROADCAST_BYTES, parked, pick, schema_with

DIM = 1024
NGRAM = 3
#: Labelled rows of each language that prototypes are fitted on, at most.
SAMPLE_PER_LANGUAGE = 400
MIN_COSINE = 0.35
#: A random vector's cosine with a prototype exceeds so many standard deviations in one case of 740.
CHANCE = 3.0
LOW_SHARE = 0.05
#: Limits are fitted for 1, 2, 4 ... n-grams, up to two to this power; in samples of natural text they reach MIN_COSINE well before.
_FITTED = 16
_BINS = 2000
_STEP = 1 << 17
#: Cells of the matrix of documents and n-grams that is held at a time.
_CELLS = 1 << 20


def _fold(code: int) -> int:
    """A letter's lower case, a combining mark itself, a space for anything else."""
    c = chr(code)
    if not c.isalpha():
        return code if unicodedata.category(c)[0] == "M" else 32
    return ord(c.lower()) if len(c.lower()) == 1 else code


_FOLD = np.array([_fold(c) for c in range(0x250)], np.int64)


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and combining marks of the texts, of any script, as code points, with every run of other characters as one space, a space around each text; and their edges."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = data[at].astype(np.int64)
    code = b.copy()
    for low, high, keep, extra in ((0xC0, 0xDF, 0x1F, 1), (0xE0, 0xEF, 0x0F, 2), (0xF0, 0xFF, 0x07, 3)):
        some = np.flatnonzero((b >= low) & (b <= high))
        if len(some):
            x = b[some] & keep
            for k in range(1, extra + 1):
                x = (x << 6) | (data[np.minimum(at[some] + k, len(data) - 1)] & 0x3F)
            code[some] = x
    near = code < len(_FOLD)
    code[near] = _FOLD[code[near]]
    far = np.flatnonzero(~near)
    if len(far):
        distinct, index = N.dense(code[far])
        code[far] = np.array([_fold(c) for c in distinct.tolist()], np.int64)[index]
    edges = np.searchsorted(at, offsets)
    n_docs = len(offsets) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(edges))
    # a space before each text and one after it
    out = np.full(len(code) + 2 * n_docs, 32, np.int64)
    out[np.arange(len(code)) + 2 * doc + 1] = code
    begin = edges[:-1] + 2 * np.arange(n_docs)
    keep = np.append(True, (out[1:] != 32) | (out[:-1] != 32))
    keep[begin] = True
    kept = np.append(0, np.cumsum(keep))
    return out[keep], np.append(kept[begin], kept[-1])


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A row of dim random signs for each code point; a space's too."""
    words = N.mix(codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dim // 64 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


class Profiles(dict[str, np.ndarray]):
    """Prototypes by language. limits[k] is the least cosine that texts of 2**k to 2**(k + 1) - 1 n-grams are accepted with; the last one holds for longer texts too."""

    limits: tuple[float, ...] = ()


def _limits(known: dict[str, np.ndarray], min_cosine: float, dim: int) -> np.ndarray:
    """The limits by the binary logarithm of the number of n-grams, between chance and min_cosine; without fitted ones min_cosine for all."""
    fitted = np.array(getattr(known, "limits", ()) or (min_cosine,))
    return np.minimum(np.maximum(fitted, CHANCE / np.sqrt(dim)), min_cosine)


def _reached(cosine: np.ndarray, counts: np.ndarray, limits: np.ndarray) -> np.ndarray:
    return cosine >= limits[np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), len(limits) - 1)]


def bundles(data: np.ndarray, offsets: np.ndarray, dim: int = DIM, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the texts, float32, and how many n-grams of letters each has. N-grams of spaces alone don't count."""
    return _bundles(*letters(data, offsets), dim, ngram)


def _bundles(code: np.ndarray, edges: np.ndarray, dim: int, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    n_docs = len(edges) - 1
    alphabet, symbol = N.dense(code)
    out, counts = np.zeros((n_docs, dim), np.float32), np.zeros(n_docs, np.int64)
    m = len(code) - ngram + 1
    if m <= 0:
        return out, counts
    gram = symbol[:m].copy()
    for k in range(1, ngram):
        gram = gram * len(alphabet) + symbol[k : k + m]
    doc = np.repeat(np.arange(n_docs), np.diff(edges))
    inside = np.flatnonzero((doc[:m] == doc[ngram - 1 :]) & (np.diff(edges)[doc[:m]] > 2))
    if not len(inside):
        return out, counts
    doc = doc[inside]
    distinct, index = N.dense(gram[inside])
    counts = np.bincount(doc, minlength=n_docs)
    vectors = letter_vectors(alphabet, dim)
    bound, rest = np.ones((len(distinct), dim), np.int8), distinct
    for k in range(ngram):  # the last letter is not shifted, the one before it by 1, and so on
        bound *= np.roll(vectors, k, axis=1)[rest % len(alphabet)]
        rest = rest // len(alphabet)
    bound = bound.astype(np.float32)
    rows = max(1, _CELLS // len(distinct))
    edge = np.searchsorted(doc, np.arange(0, n_docs + rows, rows))
    for k, a in enumerate(range(0, n_docs, rows)):
        some = slice(edge[k], edge[k + 1])
        b = min(a + rows, n_docs)
        times = np.bincount((doc[some] - a) * len(distinct) + index[some], minlength=(b - a) * len(distinct))
        out[a:b] = times.reshape(b - a, -1).astype(np.float32) @ bound
    return out, counts


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def prototypes(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, sample_per_language: int = SAMPLE_PER_LANGUAGE, dim: int = DIM, ngram: int = NGRAM) -> Profiles:
    """Each language's prototype, of length 1, from the sample_per_language labelled rows whose ids have the least hashes.

    Rows with a null language or id are passed over, null, empty and letterless texts add nothing; rows that tie with the last sampled hash are
    taken too. Ids are of any type that can be hashed. The sampled rows are written to the scratch folder; a language's are summed in one place, so a vector for
    each language and counts are all that comes to the driver. The limits are fitted on the sample too, see _fitted().
    """
    rows = pick(labelled, doc_id=id_col, text=text_col, lang=lang_col).where("lang IS NOT NULL AND doc_id IS NOT NULL").withColumn("h", F.xxhash64("doc_id"))
    cut = rows.select("lang", "h").withColumn("n", F.expr("row_number() OVER (PARTITION BY lang ORDER BY h)")).where(F.col("n") <= sample_per_language).groupBy("lang").agg(F.max("h").alias("cut"))
    cut = parked(cut, "cuts")
    n_langs = cut.count()
    if not n_langs:
        return Profiles()
    sampled = rows.join(F.broadcast(cut) if n_langs * 64 <= BROADCAST_BYTES else cut, "lang").where("h <= cut").select("lang", "text")
    n = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sampled = parked(sampled.repartition(min(n, n_langs), "lang"), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in N.pieces(batches):
            data, offsets = N.utf8(batch.column(1))
            langs = batch.column(0).to_pylist()
            for i, j in N.steps(offsets, _STEP):
                for lang, row in zip(langs[i:j], _unit(bundles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], dim, ngram)[0])):
                    sums[lang] = sums.get(lang, 0) + row.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    sums = sampled.mapInArrow(run, "lang string, v array<double>").collect()
    out: dict[str, np.ndarray] = {}
    for r in sorted(sums):
        out[r["lang"]] = out.get(r["lang"], 0) + np.array(r["v"])
    known = Profiles({lang: (v / np.linalg.norm(v)).astype(np.float32) for lang, v in sorted(out.items()) if v.any()})
    known.limits = _fitted(sampled, {lang: v.astype(np.float32) for lang, v in out.items()}, dim, ngram)
    return known


def _fitted(sampled: DataFrame, sums: dict[str, np.ndarray], dim: int, ngram: int) -> tuple[float, ...]:
    """The cosines, for 1, 2, 4 n-grams and so on, that all but LOW_SHARE of the sampled texts (lang, text) reach when cut to so many.

    A text is held against its language's prototype without itself, so the only text of a language tells nothing. Shorter texts than a number are left out of
    it. Limits don't fall with the number; one that fewer than 1 / LOW_SHARE texts speak for is that of the number before, at first 0.
    """
    sizes = [2**k for k in range(_FITTED + 1)]
    table = sampled.sparkSession.sparkContext.broadcast(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((len(sizes), _BINS), np.int64)
        for batch in N.pieces(batches):
            data, offsets = N.utf8(batch.column(1))
            langs = batch.column(0).to_pylist()
            for i, j in N.steps(offsets, _STEP):
                code, edges = letters(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                whole, counts = _bundles(code, edges, dim, ngram)
                others = np.stack([table.value[x] for x in langs[i:j]]) - _unit(whole)
                counts = np.where(np.linalg.norm(others, axis=1) > 1e-3, counts, 0)
                others = _unit(others)
                for row, n in zip(tally, sizes):
                    some = np.flatnonzero(counts >= n)
                    if len(some):
                        cut = code[(edges[some][:, None] + np.arange(n + ngram - 1)).ravel()]
                        vectors = _bundles(cut, np.arange(len(some) + 1) * (n + ngram - 1), dim, ngram)[0]
                        cosine = (_unit(vectors) * others[some]).sum(axis=1)
                        row += np.bincount(np.clip((cosine + 1) * (_BINS / 2), 0, _BINS - 1).astype(np.int64), minlength=_BINS)
        at = np.nonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(tally[at])], names=["k", "bin", "n"])

    tally = np.zeros((len(sizes), _BINS), np.int64)
    for k, b, n in sampled.mapInArrow(run, "k long, bin long, n long").groupBy("k", "bin").agg(F.sum("n").alias("n")).collect():
        tally[k, b] = n
    out, limit = [], 0.0
    for row in tally:
        if row.sum() * LOW_SHARE >= 1:
            limit = max(limit, float(np.searchsorted(np.cumsum(row), row.sum() * LOW_SHARE)) * 2 / _BINS - 1)
        out.append(limit)
    return tuple(out)


class _Judge:
    """Languages in blocks whose prototypes are small enough to broadcast; a text's best one is carried from block to block."""

    def __init__(self, docs: DataFrame, known: dict[str, np.ndarray], min_cosine: float, ngram: int):
        names, send = sorted(known), docs.sparkSession.sparkContext.broadcast
        dim = len(known[names[0]]) if names else DIM
        per = max(1, BROADCAST_BYTES // (4 * dim))
        self.blocks = [(names[k : k + per], send(np.stack([known[x] for x in names[k : k + per]]))) for k in range(0, len(names), per)]
        self.limits, self.dim, self.ngram = _limits(known, min_cosine, dim), dim, ngram

    def __call__(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(language, cosine, margin, accepted) of each text."""
        data, offsets = N.utf8(column)
        n = len(offsets) - 1
        lang, top, next_best, counts = np.full(n, None, object), np.full(n, -np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
        for i, j in N.steps(offsets, _STEP):
            vectors, counts[i:j] = bundles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], self.dim, self.ngram)
            vectors, some = _unit(vectors), slice(i, j)
            for names, table in self.blocks:
                cosine = vectors @ table.value.T
                best = cosine.max(axis=1)
                second = np.partition(cosine, -2, axis=1)[:, -2] if len(names) > 1 else np.full(j - i, -np.inf)
                ahead = best > top[some]
                next_best[some] = np.maximum(np.where(ahead, second, best), np.where(ahead, top[some], next_best[some]))
                lang[some][ahead] = np.array(names, object)[cosine.argmax(axis=1)][ahead]
                top[some] = np.maximum(top[some], best)
        judged = (counts > 0) & (top > -np.inf)
        lang[~judged] = None
        top, margin = np.where(judged, top, 0), np.where(judged, top - np.where(next_best > -np.inf, next_best, 0), 0)
        return pa.array(lang.tolist(), pa.string()), top, margin, judged & _reached(top, counts, self.limits)


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", *, min_cosine: float = MIN_COSINE, ngram: int = NGRAM) -> DataFrame:
    """(doc_id, lang, cosine, margin, accepted) for every row of docs: the language with the largest cosine, and its lead over the next.

    Of equal cosines the language first in the alphabet wins. Null, empty and letterless texts, and all texts where no
    language is known, have a null language, cosine and margin 0, and are rejected. Texts count whole, however long; each row counts by itself, with a
    null id too. Ids are whole numbers; other columns are ignored, and an empty table gives an empty one.
    """
    judge = _Judge(docs, known, min_cosine, ngram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in N.pieces(batches):
            lang, top, margin, accepted = judge(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, *map(pa.array, (top, margin, accepted))], names=["doc_id", "lang", "cosine", "margin", "accepted"])

    slim = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, lang string, cosine double, margin double, accepted boolean")


def keep_identified(docs: DataFrame, known: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang", *, min_cosine: float = MIN_COSINE, ngram: int = NGRAM) -> DataFrame:
    """The rows of docs that are accepted, all their columns as they were but lang_col, which gets the identified language.

    Null, empty and letterless texts go, and all rows where no language is known. Of equal cosines the language first in the alphabet wins. Texts count whole, however
    long; repeated rows, with a null id too, stay or go alike; an empty table gives an empty one.
    """
    judge = _Judge(docs, known, min_cosine, ngram)
    at, put = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in N.pieces(batches):
            lang, _top, _margin, accepted = judge(batch.column(at))
            columns = batch.columns
            columns[put] = lang.cast(batch.column(put).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(accepted))

    return docs.mapInArrow(run, schema_with(docs))
