"""Quality rule on repetition, by suffix array.

Every text's words are sorted as suffixes (prefix doubling, many texts in one vectorised step, no match
reaching over the end of a text). Neighbouring suffixes whose longest common prefix has min_words words or
more form LCP intervals; each member's longest prefix in its intervals is the span of a maximal repeated
substring. The spans' union gives the covered share of the text's words, the longest prefix its longest
repeat. Both are limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as N
from .shared import pick

MIN_WORDS = 8
MAX_COVERED = 0.3
MAX_LONGEST = 100

_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("repeated_words", pa.int64()), ("longest_repeat", pa.int64())])


def repeats(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: words, words that repeats of min_words or more cover, words of the longest such repeat (else 0)."""
    w = N.words(data, offsets)
    n_docs, n = len(offsets) - 1, len(w.hashes)
    sizes = np.diff(w.first)
    if not n:
        return sizes, np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    doc = w.doc
    _, symbols = N.dense(N.mix(w.hashes + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    levels = N.suffix_ranks(symbols)
    sa = N.suffix_array(levels[-1][1])
    lcp = N.neighbour_lcp(levels, sa)
    best = np.zeros(n, np.int64)
    best[sa[:-1]] = lcp
    best[sa[1:]] = np.maximum(best[sa[1:]], lcp)
    begin = np.flatnonzero(best >= min_words)
    change = np.bincount(begin, minlength=n + 1) - np.bincount(begin + best[begin], minlength=n + 1)
    covered = np.append(0, np.cumsum(np.cumsum(change)[:n] > 0))
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, doc[begin], best[begin])
    return sizes, covered[w.first[1:]] - covered[w.first[:-1]], longest


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, repeated_words, longest_repeat, repeated_fraction) for every row of docs.

    Words are compared in lower case without punctuation. Null, empty and wordless texts have no words and
    no repeats, and a fraction of 0. Each row counts by itself, so repeated rows give repeated results; a null
    id stays null; other columns of docs, of whatever name, are ignored. Texts are used whole, however long; an empty table gives an empty one. Ids are whole numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in N.pieces(batches):
            data, offsets = N.utf8(batch.column(1))
            parts = [repeats(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_words) for i, j in N.steps(offsets)]
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, columns)], schema=_OUT)

    found = pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_words long, repeated_words long, longest_repeat long")
    return found.withColumn("repeated_fraction", F.when(F.col("n_words") > 0, F.col("repeated_words") / F.col("n_words")).otherwise(F.lit(0.0)))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of repetition() that keep both limits: a share of at most max_covered, a longest repeat of at most max_longest words.

    Documents without words pass, since nothing repeats in them; so do null and empty texts. What repetition() says of odd rows holds here too.
    """
    return repetition(docs, id_col, text_col, min_words=min_words).where((F.col("repeated_fraction") <= max_covered) & (F.col("longest_repeat") <= max_longest))
