import functools

import numpy as np

from tallyspark.llm import langid as L

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then the other animals of the forest were watching with great interest because this had never happened before in their lives",
    "de": "der schnelle braune fuchs springt über den faulen hund und danach schauten die anderen tiere des waldes mit großem interesse zu weil das noch nie zuvor geschehen war",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et ensuite les autres animaux de la forêt regardaient avec beaucoup d'intérêt parce que cela ne s'était jamais passé",
}


def corpus(spark, per=12):
    rows, k = [], 0
    for lang, text in TEXTS.items():
        words = text.split()
        for i in range(per):
            k += 1
            rows.append((k, " ".join(words[i % 7 :: 1 + i % 2]), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_bundles_against_a_loop():
    texts = ["Ab c", "", "é!é", "aaaa", "日本"]
    raw = [t.encode() for t in texts]
    got, counts = L.bundles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 128)
    for t, v, n in zip(texts, got, counts):
        clean = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        while "  " in clean:
            clean = clean.replace("  ", " ")
        want, k = np.zeros(128), 0
        for i in range(len(clean) - 2) if clean.strip() else ():
            a, b, c = L.letter_vectors(np.array([ord(x) for x in clean[i : i + 3]]), 128).astype(int)
            want += np.roll(a, 2) * np.roll(b, 1) * c
            k += 1
        assert n == k and (v == want).all()


def test_held_out_accuracy(spark):
    df = corpus(spark)
    known = L.prototypes(df.where("doc_id % 2 = 0"))
    assert sorted(known) == ["de", "en", "fr"] and all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in known.values())
    got = L.identify(df.where("doc_id % 2 = 1"), known).withColumnRenamed("lang", "found").join(df, "doc_id").collect()
    assert len(got) == 18 and all(r["found"] == r["lang"] and r["accepted"] and r["margin"] > 0 for r in got)
    corpus_rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = L.prototypes(corpus_rows.where("doc_id % 2 = 0"))
    test = corpus_rows.where("doc_id % 2 = 1")
    found = L.identify(test, known).withColumnRenamed("lang", "found").join(test.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["found"] == r["lang"] for r in found) >= 0.98 * len(found)


def test_rejection_and_odd_rows(spark, docs, odd_rows):
    known = L.prototypes(corpus(spark))
    alien = " ".join(["qxzj vkwq zzxq jjqv wqxk"] * 24)
    df = docs([*odd_rows, (50, alien), (51, TEXTS["de"]), (52, "Der faule Hund.")], "cosine margin accepted")
    got = {r["doc_id"]: r for r in L.identify(df, known).collect()}
    assert not any(got[d]["accepted"] for d in (1, 2, 3, 4, 50)) and got[2]["lang"] is None and got[2]["cosine"] == 0
    assert got[51]["lang"] == "de" and got[51]["accepted"] and got[52]["accepted"]
    kept = L.keep_identified(df, known)
    assert kept.columns == df.columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert set(rows).isdisjoint({1, 2, 3, 4, 50}) and rows[51]["lang"] == "de" and rows[51]["text"] == TEXTS["de"] and rows[51]["n_chars"] == len(TEXTS["de"])
    nobody = L.prototypes(df.limit(0))
    assert nobody == {} and L.keep_identified(df, nobody).count() == 0 and L.identify(df, nobody).where("accepted").count() == 0
    assert L.identify(df.limit(0), known).count() == 0
    few = L.prototypes(corpus(spark), sample_per_language=1)
    assert sorted(few) == ["de", "en", "fr"]


def test_short_texts_are_judged(spark, docs):
    known = L.prototypes(corpus(spark))
    assert list(known.limits) == sorted(known.limits) and 0 < known.limits[-1]
    floor = L._limits(known, L.MIN_COSINE, L.DIM)
    assert min(floor) >= L.CHANCE / L.DIM**0.5 and max(floor) <= L.MIN_COSINE
    alien = [" ".join(["qxzj vkwq zzxq jjqv wqxk"] * 8), "qxzj vkwq zzxq jjqv wqxk", "qxzj vkwq zzxq", "qx"]
    df = docs([*enumerate(alien, 100), (51, TEXTS["de"]), (52, "Der faule Hund.")])
    assert {r["doc_id"] for r in L.identify(df, known).where("accepted").collect()} == {51, 52}
    assert {r["doc_id"] for r in L.keep_identified(df, known).collect()} == {51, 52}


def test_letters_of_any_script(spark, docs):
    fold = lambda t: "".join(map(chr, L.letters(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]))
    assert fold("ПРИВЕТ, Мир!") == " привет мир " and fold("ΑΒΓ") == " αβγ " and fold("日本語") == " 日本語 "
    assert fold("🙂🙂").strip() == "" and fold("１２３").strip() == "" and fold("हिन्दी") == " हिन्दी "
    known = L.prototypes(corpus(spark))
    rows = L.identify(docs([(1, "🙂 🙂🙂"), (2, "１２３ ４"), (3, "12 %")]), known).collect()
    assert all(r["lang"] is None and r["cosine"] == 0 and not r["accepted"] for r in rows)


def plain(text, protos, dim):
    """Language, cosine and margin by loops over letters and n-grams."""
    clean = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in clean:
        clean = clean.replace("  ", " ")
    if not clean.strip():
        return None, 0.0, 0.0, 0
    total = sum(gram(clean[k : k + 3], dim) for k in range(len(clean) - 2))
    cosines = sorted(((float(total @ v / np.linalg.norm(total)), lang) for lang, v in protos.items()), key=lambda x: (-x[0], x[1]))
    return cosines[0][1], cosines[0][0], cosines[0][0] - cosines[1][0], len(clean) - 2


def test_the_query_against_loops(spark, monkeypatch):
    """op4_language_id as it is registered, over the whole table: cosine, language, margin and acceptance of every document by loops; with blocks of one language too."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    protos = {}
    for r in rows:
        if r["lang"] is not None and r["text"]:
            one = plain_vector(r["text"], L.DIM)
            protos[r["lang"]] = protos.get(r["lang"], 0) + one
    protos = {lang: v / np.linalg.norm(v) for lang, v in protos.items()}
    from tallyspark.llm import queries

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    limits = L._limits(L.prototypes(df), L.MIN_COSINE, L.DIM)
    got = {r["doc_id"]: r for r in queries.op4_language_id(spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        lang, cosine, margin, n = plain(r["text"] or "", protos, L.DIM)
        limit = limits[min(int(np.log2(max(n, 1))), len(limits) - 1)]
        if abs(cosine - limit) > 1e-4:
            assert (r["doc_id"] in got) == (lang is not None and cosine > limit)
        if r["doc_id"] in got:
            g = got[r["doc_id"]]
            assert abs(g["cosine"] - cosine) < 1e-4 and abs(g["margin"] - margin) < 1e-4 and (g["lang"] == lang or margin < 1e-4)
    monkeypatch.setattr(L, "BROADCAST_BYTES", 4 * L.DIM)
    blocks = {r["doc_id"]: r for r in queries.op4_language_id(spark, "/root/testdata/sf0.001").collect()}
    assert blocks.keys() == got.keys() and all(blocks[d]["lang"] == got[d]["lang"] and abs(blocks[d]["margin"] - got[d]["margin"]) < 1e-6 for d in got)


def plain_vector(text, dim):
    """A text's bundle of length 1, by loops."""
    clean = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in clean:
        clean = clean.replace("  ", " ")
    total = sum((gram(clean[k : k + 3], dim) for k in range(len(clean) - 2) if clean.strip()), np.zeros(dim))
    return total / max(np.linalg.norm(total), 1e-12)


@functools.cache
def gram(letters, dim):
    a, b, c = (L.letter_vectors(np.array([ord(x)]), dim)[0].astype(float) for x in letters)
    return np.roll(a, 2) * np.roll(b, 1) * c
