"""The corpus operators as named queries over the synthetic tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lines, packing, quality, sharding, simhash, store, substring, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in their shards, by source and id."""
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, archived, indexed and read back by their index."""
    return warc.archived(_table(spark, sf_dir, "pages")).withColumnRenamed("record_id", "page_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without lines of recurring templates, those of one token included."""
    return lines.line_dedup(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are accepted, with their language, cosine and margin."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.prototypes(docs)).where("accepted").drop("accepted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of documents that an earlier document has too."""
    return substring.repeated_spans(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in windows of tokens."""
    return packing.pack(packing.token_lengths(_table(spark, sf_dir, "documents")))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and the number of its links."""
    return simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's manifest line after its ids were stored by content, and whether it verifies."""
    return store.stored_and_verified(_table(spark, sf_dir, "documents"))


def op9_quality_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass the repetition limits, with their figures."""
    return quality.quality_filter(_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of documents that benchmark phrases cover, with the items' ids as text."""
    spans = decontam.contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return spans.withColumn("item_ids", F.array_join("item_ids", ","))


QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_warc, op3_line_dedup, op4_language_id, op5_substring_dedup, op6_packing, op7_simhash_near_dedup, op8_token_store, op9_quality_repetition, op10_benchmark_decontamination)
}

_WORDS = r"list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[ \t\n\r\f\v]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op1_sharding": f"""
WITH slim AS (SELECT coalesce(source, '') AS k0, doc_id AS k1, strlen(coalesce(text, ''))::BIGINT AS b FROM documents),
lim AS (SELECT total, rg, greatest(1, least({sharding.MAX_SHARD_BYTES}, floor({sharding.SLACK} * total / rg)))::BIGINT AS l FROM (SELECT sum(b) AS total, greatest({sharding.RANGES}, ceil(sum(b) / {sharding.RANGE_BYTES}))::BIGINT AS rg FROM slim)),
clock AS (SELECT k0, k1, -ln((('0x' || substr(md5(k0 || '/' || k1), 1, 12))::BIGINT::DOUBLE + 1) / {2**48 + 1}) / b AS c FROM slim WHERE b > 0),
sample AS (SELECT k0, k1 FROM clock, lim WHERE c <= rg * {sharding.OVERSAMPLE} / total),
place AS (SELECT k0, k1, row_number() OVER (ORDER BY k0, k1) - 1 AS i, count(*) OVER () AS n FROM sample),
point AS (SELECT DISTINCT k0, k1 FROM place JOIN (SELECT unnest(range(1, rg)) AS k, rg FROM lim) r ON i = r.k * n // rg),
merged AS (SELECT k0, k1, b, 0 AS p FROM slim UNION ALL SELECT k0, k1, 0, 1 FROM point),
ranged AS (SELECT k0, k1, b, p, (sum(p) OVER (ORDER BY k0, k1, p DESC ROWS UNBOUNDED PRECEDING))::INT AS range_id FROM merged),
sized AS (SELECT range_id, k0, k1, b, sum(b) OVER (PARTITION BY range_id) AS t, sum(b) OVER (PARTITION BY range_id ORDER BY k0, k1 ROWS UNBOUNDED PRECEDING) - b AS before FROM ranged WHERE p = 0),
sub AS (SELECT range_id, k0, k1, CASE WHEN t > l THEN before // l ELSE 0 END AS s FROM sized, lim)
SELECT d.*, sub.range_id, (dense_rank() OVER (PARTITION BY sub.range_id ORDER BY s) - 1)::INT AS sub_id FROM documents d JOIN sub ON sub.k0 = coalesce(d.source, '') AND sub.k1 = d.doc_id
""",
    "op2_warc": "SELECT page_id, url, sha256(html) AS digest, html, true AS verified FROM pages",
    "op10_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bg AS (SELECT DISTINCT item_id, w[i:i + 12] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b)),
dg AS (SELECT doc_id, i - 1 AS s, w[i:i + 12] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
short AS (SELECT DISTINCT item_id, w AS g, len(w) AS n FROM b WHERE len(w) BETWEEN {decontam.SHORTEST} AND 12),
brief AS (SELECT doc_id, n, i - 1 AS s, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM short))),
hit AS (SELECT doc_id, s, s + 13 AS e, item_id FROM dg JOIN bg USING (g) UNION ALL SELECT doc_id, s, s + n, item_id FROM brief JOIN short USING (n, g)),
place AS (SELECT DISTINCT doc_id, s, e FROM hit),
fresh AS (SELECT doc_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM place),
run AS (SELECT doc_id, s, e, sum(f) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS r FROM fresh)
SELECT run.doc_id, min(run.s)::BIGINT AS start_word, (max(run.e) - min(run.s))::BIGINT AS n_words, array_to_string(list_sort(list_distinct(list(hit.item_id))), ',') AS item_ids
FROM run JOIN hit USING (doc_id, s, e) GROUP BY run.doc_id, run.r
""",
    "op5_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS s, hash(w[i:i + {substring.MIN_WORDS - 1}]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring.MIN_WORDS - 2})) AS i FROM d)),
hit AS (SELECT DISTINCT doc_id, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM g) WHERE first < doc_id),
fresh AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {substring.MIN_WORDS} THEN 0 ELSE 1 END AS f FROM hit),
run AS (SELECT doc_id, s, sum(f) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM fresh)
SELECT doc_id, min(s)::BIGINT AS start_word, (max(s) - min(s) + {substring.MIN_WORDS})::BIGINT AS n_words FROM run GROUP BY doc_id, r
""",
    "op9_quality_repetition": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, hash(w[i:i + {quality.MIN_WORDS - 1}]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality.MIN_WORDS - 2})) AS i FROM d)),
pair AS (SELECT a.doc_id, a.i, b.i - a.i AS far FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.h = b.h AND a.i < b.i),
run AS (SELECT doc_id, count(*) + {quality.MIN_WORDS - 1} AS long FROM (SELECT doc_id, far, i - row_number() OVER (PARTITION BY doc_id, far ORDER BY i) AS r FROM pair) GROUP BY doc_id, far, r),
longest AS (SELECT doc_id, max(long) AS long FROM run GROUP BY doc_id),
place AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, sum(least({quality.MIN_WORDS}, coalesce(next - i, {quality.MIN_WORDS}))) AS words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM place) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n, coalesce(words, 0) AS words, coalesce(long, 0) AS long FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN longest USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, words::BIGINT AS repeated_words, long::BIGINT AS longest_repeat, CASE WHEN n > 0 THEN words / n ELSE 0.0 END AS repeated_fraction FROM f WHERE (n = 0 OR words / n <= {quality.MAX_COVERED}) AND long <= {quality.MAX_LONGEST}
""",
}
