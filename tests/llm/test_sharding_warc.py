import gzip
import hashlib
import random
from collections import defaultdict

from tallyspark.llm import sharding, warc


def test_shards(spark):
    dice = random.Random(9)
    rows = [(k, "x" * dice.choice([0, 1, 50, 400, 3000]), dice.choice(["hot"] * 5 + ["a", "b", None])) for k in range(3000)]
    rows += [(None, "y" * 100, "hot"), (None, None, None)] + [(5000, "z" * 900, "hot")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS range_id", "'q' AS points", "'q' AS cuts", *[f"'q' AS {c}" for c in ("__points", "__cuts", "split", "PARTS", "own_cuts", "shard", "k", "b")])
    out = sharding.shards(df, ranges=16, oversample=32)
    got = out.collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["source"]) for r in got))) == sorted(map(repr, rows)) and out.columns == [c for c in df.columns if c != "range_id"] + ["range_id", "sub_id"]
    sizes, keys = defaultdict(int), defaultdict(list)
    order = lambda r: (r["source"] is not None, r["source"] or "", r["doc_id"] is not None, r["doc_id"] or 0)
    for r in got:
        shard = (r["range_id"], r["sub_id"])
        sizes[shard] += len(r["text"] or "")
        keys[shard].append(order(r))
    total = sum(len(t or "") for _, t, _ in rows)
    assert max(v for s, v in sizes.items() if (True, "hot", True, 5000) not in keys[s]) <= 1.25 * total / 16 + 3000
    shards = sorted(keys)
    for a, b in zip(shards, shards[1:]):
        assert max(keys[a]) < min(keys[b])
    assert len({s for s in shards if (True, "hot", True, 5000) in keys[s]}) == 1
    assert len(shards) >= 16 and sharding.shards(df.limit(0), ranges=4).count() == 0
    for part in out.rdd.glom().map(lambda p: [((r["range_id"], r["sub_id"]), r) for r in p]).collect():
        assert len({s for s, _ in part}) <= 1 and [order(r) for _, r in part] == sorted(order(r) for _, r in part)
    few = sharding.shards(df, oversample=8).select("range_id").distinct().count()
    assert few > 100  # RANGES of them, where bytes don't ask for more


def test_ranges_follow_the_bytes(spark, monkeypatch):
    df = spark.range(2000).selectExpr("id AS doc_id", "'s' AS source", "repeat('x', 1000) AS text")
    monkeypatch.setattr(sharding, "RANGES", 4)
    monkeypatch.setattr(sharding, "RANGE_BYTES", 40_000)
    out = sharding.shards(df).groupBy("range_id", "sub_id").count().collect()
    assert max(r["range_id"] for r in out) >= 40 and max(r["count"] for r in out) <= 51
    monkeypatch.setattr(sharding, "BROADCAST_BYTES", 600)  # so few splitters are broadcast that subdivision must make up for it
    out = sharding.shards(df).groupBy("range_id", "sub_id").count().collect()
    assert max(r["range_id"] for r in out) < 12 and max(r["sub_id"] for r in out) >= 3 and max(r["count"] for r in out) <= 51


def pages(spark):
    rows = [(k, f"http://e.org/{k}?q=a b\r\nX: é", f"<p>page {k} ü</p>" * (k % 50)) for k in range(300)]
    rows += [(300, None, "<p>"), (301, "http://x", None), (None, "http://y", ""), (302, "http://z", "WARC/1.0\r\n\r\n" * 9), (302, "http://z", "WARC/1.0\r\n\r\n" * 9), (303, "http://long", "x" * 3_000_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS offset", "'x' AS digest").repartition(3)


def test_archives_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    index = warc.write(df, f"file://{tmp_path}/w")
    got = warc.read(index)
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
    assert sorted(((r["record_id"], r["url"], r["html"]) for r in got.collect()), key=key) == sorted(rows, key=key)
    assert got.where("NOT verified").count() == 0
    some = warc.read(index.where("record_id % 7 = 0"), max_gap=100, max_read=5000)
    assert {r["record_id"] for r in some.collect()} == {k for k, _, _ in rows if k is not None and k % 7 == 0}
    wrong = warc.read(index.where("record_id = 5").selectExpr("file", "offset", "length", "record_id", "url", "'0' AS digest"))
    assert [r["verified"] for r in wrong.collect()] == [False]
    again = warc.index_files(index.select("file").distinct())
    columns = ("file", "offset", "length", "record_id", "digest")
    assert sorted(map(tuple, again.select(*columns).collect()), key=str) == sorted(map(tuple, index.select(*columns).collect()), key=str)
    assert warc.archived(df.limit(0)).count() == 0


def test_a_foreign_archive(spark, tmp_path):
    """Records as other writers make them: names that are UUIDs, SHA-1 digests, folded and blankless headers, other types, bytes that are no UTF-8."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>caf\xc3\xa9 \xff</p>"
    records = [
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\nsoft\r\n\r\n",
        b"WARC/1.1\r\nwarc-type:response\r\nWARC-Record-ID:<urn:uuid:2>\r\nWARC-Target-URI: http://a.org/\r\n\tx\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http),
        b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Target-URI: http://b.org\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n",
    ]
    members = [gzip.compress(r) for r in records]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(members) + members[0][:9])  # the last one breaks off
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{tmp_path}/f.warc.gz",), (f"file://{tmp_path}/empty.warc.gz",), (None,)], "file string")
    index = warc.index_files(files)
    rows = sorted(index.collect(), key=lambda r: r["offset"])
    assert [(r["warc_type"], r["warc_id"], r["record_id"], r["url"]) for r in rows] == [("warcinfo", "<urn:uuid:1>", None, None), ("response", "<urn:uuid:2>", None, "http://a.org/ x"), ("request", None, None, None), ("resource", None, 7, "http://b.org")]
    assert [r["length"] for r in rows] == [*map(len, members)] and rows[1]["digest"] == hashlib.sha256(http).hexdigest()
    got = {(r["record_id"], r["url"]): (r["html"], r["verified"]) for r in warc.read(index).collect()}
    assert got == {(None, None): (None, True), (None, "http://a.org/ x"): ("<p>café \ufffd</p>", True), (7, "http://b.org"): ("hi", True)}
