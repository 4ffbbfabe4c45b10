"""Line deduplication by a log-template tree.

Each line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, DEPTH of them, tokens with
digits counting as variable. In a leaf, lines join the template they agree with in a share of SIMILARITY of their
tokens, and the tokens that differ become variable too; else they start one. Templates that recur in MIN_DOCS documents are dropped
everywhere but in the document of least id.

The tree is distributed by its leaves. Only leaves that MIN_DOCS documents reach and that hold several distinct lines need
their lines compared; in the others the line itself is the template, and only hashes move. A line is known by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import parked, quoted, unused

DEPTH = 5
SIMILARITY = 0.6
MIN_DOCS = 6
MIN_TOKENS = 1
ANY = "<*>"


def masked(line: Column) -> Column:
    """A line without outer white space, tokens with a digit as <*>."""
    bare = F.btrim(line, F.lit(" \t\r\f\x0b"))
    return F.when(bare.rlike("\\d"), F.regexp_replace(bare, "\\S*\\d\\S*", ANY)).otherwise(bare)


def _names(line: Column | str) -> list[Column]:
    """The two hashes that a masked line is known by."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(7), line).alias("g")]


class Leaf:
    """The templates of one leaf: of each number of tokens a matrix of token codes, 0 where any token fits, and the lines that started them."""

    def __init__(self, similarity: float):
        self.similarity, self.codes, self.held = similarity, {ANY: 0}, {}

    def place(self, line: str, name: object) -> object:
        """The name of the line that started the template which this line, called `name`, belongs to: of those it agrees with enough the first that it
        agrees with most, else a new one."""
        own = np.array([self.codes.setdefault(t, len(self.codes)) for t in line.split()], np.int64)
        rows, starts = self.held.setdefault(len(own), (np.zeros((4, len(own)), np.int64), []))
        if starts:
            some = rows[: len(starts)]
            same = ((some == own) | (some == 0)).sum(axis=1)
            best = int(same.argmax())
            if same[best] >= self.similarity * len(own):
                some[best][some[best] != own] = 0
                return starts[best]
        if len(starts) == len(rows):
            rows = np.concatenate([rows, np.zeros_like(rows)])
            self.held[len(own)] = rows, starts
        rows[len(starts)] = own
        starts.append(name)
        return name


def grow(lines: list[str], similarity: float = SIMILARITY) -> list[int]:
    """For the distinct masked lines of one leaf, in order, the index of the line that started each one's template."""
    leaf = Leaf(similarity)
    return [leaf.place(line, i) for i, line in enumerate(lines)]


def _templates(multi: DataFrame, similarity: float) -> DataFrame:
    """(h, g, th, tg), each line's hashes and those of its template, for the lines (leaf, line, df) of leaves that hold several. A task holds one leaf's templates at a time, not its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaf = None, Leaf(similarity)
        for batch in batches:
            out: list[tuple] = []
            for at, h, g, line in zip(*(batch.column(c).to_pylist() for c in ("leaf", "h", "g", "line"))):
                if at != now:
                    now, leaf = at, Leaf(similarity)
                out.append((h, g, *leaf.place(line, (h, g))))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["h", "g", "th", "tg"])

    n = int(multi.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return multi.repartition(n, "leaf").sortWithinPartitions("leaf", F.desc("df"), "line").select("leaf", *_names("line"), "line").mapInArrow(run, "h long, g long, th long, tg long")


def recurring(docs: DataFrame, id_col: str, text_col: str, *, depth: int, similarity: float, min_docs: int, min_tokens: int) -> DataFrame:
    """(doc_id, drop): for each document, the hashes of its masked lines that are to go."""
    slim = docs.where(quoted(text_col).isNotNull()).select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))

    def lines(rows: DataFrame, *columns: Column | str) -> DataFrame:
        every = F.array_distinct(F.transform(F.split("text", "\n"), masked))
        out = rows.select(*[c for c in rows.columns if c != "text"], F.explode(every).alias("line")).where("line <> ''")
        out = out.withColumn("tokens", F.split("line", "\\s+")).where(F.size("tokens") >= min_tokens)
        return out.select("*", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf")).select(*columns)

    seen = parked(lines(slim.withColumn("row", F.monotonically_increasing_id()), "row", "doc_id", *_names("line"), "leaf"), "lines")
    stats = seen.groupBy("h", "g", "leaf").agg(F.count("*").alias("df"), F.min("doc_id").alias("first"))
    leaves = stats.groupBy("leaf").agg(F.sum("df").alias("n"), F.count("*").alias("distinct")).where((F.col("n") >= min_docs) & (F.col("distinct") > 1)).select("leaf")
    leaves = parked(leaves, "leaves")
    multi = lines(slim, "leaf", "line").join(leaves, "leaf").groupBy("leaf", "line").agg(F.count("*").alias("df"))
    templates = parked(_templates(multi, similarity), "templates")
    of_template = seen.join(templates, ["h", "g"]).groupBy("th", "tg").agg(F.count_distinct("row").alias("df"), F.min("doc_id").alias("first")).where(F.col("df") >= min_docs)
    verdict = templates.join(of_template, ["th", "tg"]).select("h", "g", "first").unionByName(stats.where(F.col("df") >= min_docs).join(leaves, "leaf", "left_anti").select("h", "g", "first"))
    gone = seen.select("doc_id", "h", "g").join(verdict, ["h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id").agg(F.collect_set(F.struct("h", "g")).alias("drop"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", *, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """docs without the lines whose template recurs, n_chars recounted, and dropped_lines, how many went.

    Every row and column stays, whatever its name, but dropped_lines of docs, which is replaced; a text that loses all its lines becomes empty. Lines end at line
    feeds and are compared without outer white space; lines of fewer than min_tokens tokens, empty ones among them, always stay. A template counts once for each row
    it occurs in, rows of one id and rows with a null id each by themselves, and stays in the rows of the least id that has it; a null id is the greatest. Of
    equally frequent lines of a leaf the first in byte order starts the template. Texts count whole, however long. Null and empty texts stay as they are, an empty
    table gives an empty one.
    """
    docs = docs.drop("dropped_lines")
    own_id, drop, kept = unused(docs.columns, "own_id", "drop", "kept")
    gone = recurring(docs, id_col, text_col, depth=depth, similarity=similarity, min_docs=min_docs, min_tokens=min_tokens).select(F.col("doc_id").alias(own_id), F.col("drop").alias(drop))
    joined = docs.join(gone.hint("shuffle_hash"), quoted(id_col).eqNullSafe(F.col(own_id)), "left")
    split = F.split(quoted(text_col), "\n")
    lines = F.transform(split, lambda x: F.struct(x.alias("line"), masked(x).alias("masked")))
    left = F.transform(F.filter(lines, lambda x: ~F.array_contains(drop, F.struct(*_names(x["masked"])))), lambda x: x["line"])
    hit = F.col(drop).isNotNull() & quoted(text_col).isNotNull()
    out = joined.withColumn(kept, F.when(hit, left))
    text = F.when(hit, F.array_join(kept, "\n")).otherwise(quoted(text_col))
    dropped = F.when(hit, F.size(split) - F.size(kept)).otherwise(0)
    count = lambda c: F.when(hit, F.length(text).cast(docs.schema[c].dataType)).otherwise(quoted(c)).alias(c)
    columns = [text.alias(c) if c == text_col else count(c) if c == n_chars_col else quoted(c) for c in docs.columns]
    return out.select(*columns, dropped.alias("dropped_lines"))
