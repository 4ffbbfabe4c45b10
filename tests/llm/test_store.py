import random

import numpy as np

from tallyspark.llm import queries, store, tokens
from tallyspark.llm import textnum as N


def test_ids_are_the_tokenizers():
    e = tokens.encoder()
    for text in ("Hello, wörld!\n\n 12 <|endoftext|>", "a  b", "", None):
        assert tokens.ids(text).tolist() == (e.encode_ordinary(text) if text else [])
    assert e.decode(tokens.ids("Straße 日本 🙂").tolist()) == "Straße 日本 🙂"


def test_cuts_are_local_and_bounded():
    rng = np.random.default_rng(1)
    streams = [rng.integers(0, 500, n).astype(np.uint16) for n in (0, 5, 4000, 0, 900)] + [np.zeros(3000, np.uint16)]
    edges = np.cumsum([0, *map(len, streams)])
    ends = store.cuts(np.concatenate(streams), edges, 8, 64, 200)
    alone = [store.cuts(s, np.array([0, len(s)]), 8, 64, 200) + a for s, a in zip(streams, edges)]
    assert ends.tolist() == np.concatenate(alone).tolist()
    assert set(edges[1:][np.diff(edges) > 0]) <= set(ends.tolist()) and np.diff(np.append(0, ends)).max() <= 200
    shifted = store.cuts(np.concatenate([[7], streams[2]]).astype(np.uint16), np.array([0, 4001]), 8, 64, 10**6) - 1
    own = store.cuts(streams[2], np.array([0, 4000]), 8, 64, 10**6)
    assert set(own[1:].tolist()) <= set(shifted.tolist())
    assert store.cuts(np.zeros(0, np.uint16), np.array([0, 0])).tolist() == []


def test_merkle():
    a, b, c = (store.digest(x) for x in (b"a", b"b", b"c"))
    assert len({store.merkle(x) for x in ([], [a], [b], [a, b], [b, a], [a, b, c], [a, b, c, c])}) == 7


def test_round_trip_and_damage(spark, docs, odd_rows, prose, tmp_path):
    rows = [*odd_rows, (90, prose(1, 3000)), (91, "new start " + prose(1, 3000)), (92, prose(1, 3000))]
    df = docs(rows, "digest ids n_ids doc_key")
    folder = f"file://{tmp_path}/s"
    store.save(df, folder)
    seen = store.verify(spark, folder).collect()
    assert len(seen) == len(rows) and all(r["verified"] for r in seen)
    assert {r["doc_id"]: r["n_chunks"] for r in seen if r["doc_id"] in (1, 2)} == {1: -1, 2: 0}
    back = sorted((str(r["doc_id"]), r["ids"]) for r in store.reconstruct(spark, folder).collect())
    assert back == sorted((str(d), None if t is None else tokens.ids(t).tolist()) for d, t in rows)
    chunks = spark.read.parquet(f"{folder}/store/kind=chunk")
    references = spark.read.parquet(f"{folder}/store/kind=reference").where("digest IS NOT NULL")
    assert chunks.count() == chunks.select("digest").distinct().count() == references.select("digest").distinct().count() < 0.6 * references.count()
    bad = chunks.orderBy("digest").toPandas()
    k = random.Random(0).randrange(len(bad))
    bad.at[k, "ids"] = bad.at[k, "ids"][:-2] + b"\xff\xff"
    spark.createDataFrame(bad, chunks.schema).write.mode("overwrite").parquet(f"file://{tmp_path}/x/store/kind=chunk")
    for kind in ("reference", "manifest"):
        spark.read.parquet(f"{folder}/store/kind={kind}").write.parquet(f"file://{tmp_path}/x/store/kind={kind}")
    hurt = {r["doc_key"] for r in references.where(references.digest == bytearray(bad.at[k, "digest"])).collect()}
    assert sum(not r["verified"] for r in store.verify(spark, f"file://{tmp_path}/x").collect()) == len(hurt) > 0
    store.save(df.limit(0), f"file://{tmp_path}/e")
    assert store.verify(spark, f"file://{tmp_path}/e").count() == 0


def plain_cuts(stream, window, mean, longest):
    """Chunks of one stream, id by id."""
    ends, begin = [], 0
    for k in range(len(stream)):
        hit = False
        if k + 1 >= window:
            h = N.grams(N.mix(np.asarray(stream[k + 1 - window : k + 1], np.uint64) + np.uint64(1)), window)[0]
            hit = int(h) % mean == 0
        if hit or k + 1 == len(stream):
            while k + 1 - begin > longest:
                begin += longest
                ends.append(begin)
            begin = k + 1
            ends.append(begin)
    return ends


def plain_root(names):
    import hashlib

    h = lambda b: hashlib.blake2b(b, digest_size=16).digest()
    level = [h(b"\0" + x) for x in names]
    if not level:
        return h(b"")
    while len(level) > 1:
        level = [h(b"\1" + b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def test_the_query_against_loops(spark):
    """op8_token_store as it is registered, over the whole table: chunks cut id by id, their digests, and each document's root."""
    import hashlib

    got = {r["doc_id"]: r for r in queries.op8_token_store(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        stream = tokens.encoder().encode_ordinary(r["text"] or "")
        ends = plain_cuts(stream, 16, 256, 1024)
        names = [hashlib.blake2b(np.array(stream[a:b], "<u2").tobytes(), digest_size=16).digest() for a, b in zip([0, *ends], ends)]
        line = got[r["doc_id"]]
        assert line["verified"] and line["n_ids"] == len(stream) and line["n_chunks"] == (len(names) if r["text"] is not None else -1)
        assert line["root"] == plain_root(names).hex().upper()


def test_a_chunk_that_all_documents_have(spark, docs, prose, tmp_path):
    shared = prose(1, 1500)
    df = docs([(d, f"{shared}\n{prose(100 + d, 30)}") for d in range(200)]).repartition(4)
    store.save(df, f"file://{tmp_path}/s")
    files = spark.read.parquet(f"{tmp_path}/s/store/kind=reference").selectExpr("input_file_name() AS f").groupBy("f").count().toPandas()
    assert len(files) >= 4 and files["count"].max() < 0.5 * files["count"].sum()  # references don't meet in the chunk's task
    assert spark.read.parquet(f"{tmp_path}/s/store/kind=chunk").groupBy("digest").count().where("count > 1").count() == 0
    assert store.verify(spark, f"file://{tmp_path}/s").where("verified").count() == 200
