import hashlib
import itertools

import corpus_pipeline as C
import numpy as np
from test_langid import plain, plain_vector
from test_lines import brute as brute_lines
from test_packing import check, placements, window_by_window

from tallyspark.llm import langid, packing, simhash, tokens
from tallyspark.llm import textnum as N
from tallyspark.llm.shared import parked


def test_stages_in_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert sorted(out.columns) == sorted(columns) and dict(out.dtypes) == dict(docs.dtypes), name
        docs = C.parked(out, name)
        assert docs.count() <= n
        n = docs.count()
    placed = C.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert placed.agg({"n_tokens": "sum"}).first()[0] > 0
    assert [name for name, _ in C.STAGES] == ["language_id", "line_dedup", "near_dedup", "benchmark_decontamination", "packing"]
    run = C.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, placed.collect()))


def test_empty_corpus(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


PUNCTUATION = {c for c in map(chr, range(33, 127)) if not c.isalnum()}


def words_of(text):
    """(word, start, end) by characters: white space parts words, ASCII punctuation doesn't count, a character from U+3000 up is a word."""
    out, now = [], None
    for k, c in enumerate(text):
        if c in " \t\n\r\f\x0b":
            now = None
        elif c not in PUNCTUATION:
            if now is None or ord(c) >= 0x3000 or ord(text[out[-1][2] - 1]) >= 0x3000:
                out.append(["", k, k])
                now = out[-1]
            now[0] += c.lower() if c < "\x80" or "À" <= c <= "Þ" else c
            now[2] = k + 1
    return out


def without_benchmark(text, phrases, n=13):
    """The text with every run of words cut out that n-word phrases cover, window by window."""
    words, covered = words_of(text), []
    for k in range(len(words) - n + 1):
        if tuple(w[0] for w in words[k : k + n]) in phrases:
            if covered and k <= covered[-1][1]:
                covered[-1][1] = k + n
            else:
                covered.append([k, k + n])
    out, done = [], 0
    for a, b in covered:
        out.append(text[done : words[a][1]])
        done = words[b - 1][2]
    return "".join([*out, text[done:]])


def plain_print(text):
    """A fingerprint by voting word by word."""
    raw = text.encode()
    w = N.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    if not len(w.hashes):
        return int.from_bytes(hashlib.blake2b(raw.strip(), digest_size=32).digest(), "big")
    votes = [0.0] * 256
    for h, size in {int(h): int(e - s) for h, s, e in zip(w.hashes, w.start, w.end)}.items():
        bits = b"".join(int(N.mix(np.array([h + k * 0x9E3779B97F4A7C15 & 2**64 - 1], np.uint64))[0]).to_bytes(8, "little") for k in range(1, 5))
        weight = 1 if size <= 3 else 4 if size == 4 else 10
        for b in range(256):
            votes[b] += weight if bits[b // 8] >> 7 - b % 8 & 1 else -weight
    return sum(1 << 255 - b for b in range(256) if votes[b] > 0)


def test_each_stage_against_plain_loops(spark):
    """The stages over sf0.001, each one's rows against loops over what the stage before kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage, columns = dict(C.STAGES), docs.columns
    text = {r["doc_id"]: r["text"] for r in docs.collect()}

    out = parked(stage["language_id"](spark, docs, sf), "t")
    limits = langid._limits(langid.prototypes(docs), langid.MIN_COSINE, langid.DIM)
    protos = {}
    for r in docs.collect():
        protos[r["lang"]] = protos.get(r["lang"], 0) + plain_vector(r["text"], langid.DIM)
    protos = {lang: v / np.linalg.norm(v) for lang, v in protos.items()}
    kept = {r["doc_id"]: r for r in out.collect()}
    for d, t in text.items():
        lang, cosine, margin, n = plain(t, protos, langid.DIM)
        limit = limits[min(int(np.log2(max(n, 1))), len(limits) - 1)]
        assert abs(cosine - limit) < 1e-4 or (d in kept) == (lang is not None and cosine > limit)
        assert d not in kept or (kept[d]["text"] == t and (kept[d]["lang"] == lang or margin < 1e-4))
    assert out.columns == columns and len(kept) > 0.9 * len(text)
    text = {d: r["text"] for d, r in kept.items()}

    out = parked(stage["line_dedup"](spark, out, sf), "t")
    want = dict(brute_lines(list(text.items())))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in out.collect() if want[r["doc_id"]] != text[r["doc_id"]])
    assert out.columns == columns and want != text
    text = want

    out = parked(stage["near_dedup"](spark, out, sf), "t")
    prints = {d: plain_print(t) for d, t in text.items()}
    group = {d: d for d in text}
    root = lambda d: d if group[d] == d else root(group[d])
    for a, b in itertools.combinations(sorted(text), 2):
        if (prints[a] ^ prints[b]).bit_count() <= simhash.MAX_BITS:
            x, y = sorted((root(a), root(b)))
            group[y] = x
    want = {d: t for d, t in text.items() if root(d) == d}
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == columns and want.items() <= got.items() and len(got) - len(want) <= 0.1 * (len(text) - len(want)) and len(want) < len(text)
    text = got

    out = parked(stage["benchmark_decontamination"](spark, out, sf), "t")
    phrases = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        ws = tuple(w[0] for w in words_of(r["text"] or ""))
        phrases |= {ws[k : k + 13] for k in range(len(ws) - 12)}
    want = {d: without_benchmark(t, phrases) for d, t in text.items()}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want and out.columns == columns
    text = want

    out = stage["packing"](spark, out, sf)
    windows = placements(out)
    check([(d, len(tokens.ids(t))) for d, t in text.items()], windows, packing.CAPACITY)
    window_by_window(windows, packing.CAPACITY)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(C.run(spark, sf)) == key(out)
