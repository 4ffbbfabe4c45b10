import random

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import decontam as D
from tallyspark.llm import textnum as N


def test_index_against_brute_force():
    dice = random.Random(2)
    for _ in range(40):
        texts = [" ".join(f"v{dice.randrange(5)}" for _ in range(dice.randrange(0, 40))) for _ in range(dice.randrange(1, 6))]
        data, offsets = N.utf8(pa.array(texts))
        w = N.words(data, offsets)
        index = D.FMIndex(w.hashes, w.first, sample=dice.choice([1, 3, 16]))
        index = dice.choice([index, D.FMIndex.load(index.dump())])
        n = dice.randrange(1, 5)
        probe = N.words(*N.utf8(pa.array([" ".join(f"v{dice.randrange(6)}" for _ in range(n)) for _ in range(30)]))).hashes.reshape(-1, n)
        phrase, place = index.search(probe)
        got = sorted(zip(phrase.tolist(), place.tolist()))
        want = []
        for p, row in enumerate(probe.tolist()):
            for d in range(len(texts)):
                own = w.hashes[w.first[d] : w.first[d + 1]].tolist()
                want += [(p, int(index.begins[d]) + k) for k in range(len(own) - n + 1) if own[k : k + n] == row]
        assert got == sorted(want)


@pytest.mark.parametrize("limit", [1 << 20, 600])
def test_spans_are_merged_and_cut(spark, docs, odd_rows, prose, limit):
    item = prose(50, 40)
    leak = item.upper().replace(" ", ", ")
    rows = [*odd_rows, (20, f"{prose(60, 50)} {leak} {prose(61, 50)}"), (21, leak), (22, " ".join(item.split()[:12]) + " z"), (23, f"a {item} b {item} {item}"), (23, f"a {item} b")]
    bench = spark.createDataFrame([(1, item), (2, " ".join(item.split()[10:30])), (3, None), (None, item), (4, "too short"), (5, ""), (1, item)], "item_id long, text string")
    df = docs(rows, "start_word gram item_id row __row span_id cuts __spans __span_id")
    got = sorted((r["doc_id"], r["start_word"], r["n_words"], tuple(sorted(r["item_ids"]))) for r in D.contaminated_spans(df, bench, broadcast_bytes=limit, shard_bytes=500).collect())
    assert got == [(20, 50, 40, (1, 2)), (21, 0, 40, (1, 2)), (23, 1, 40, (1, 2)), (23, 1, 40, (1, 2)), (23, 42, 80, (1, 2))]
    clean = D.decontaminate(df, bench, broadcast_bytes=limit)
    assert clean.columns == df.columns and {r["__row"] + r["row"] + r["cuts"] for r in clean.collect()} == {"xxx"}
    out = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in clean.collect() if r["doc_id"] and r["doc_id"] >= 20))
    assert out[0] == (20, f"{prose(60, 50)} , {prose(61, 50)}".replace(" , ", "  "), len(prose(60, 50)) + len(prose(61, 50)) + 2)
    assert out[1] == (21, "", 0) and out[2][1] == rows[12][1] and [x[1] for x in out[3:]] == ["a  b", "a  b "]
    untouched = lambda f: sorted((str(r["doc_id"]), r["text"] or "", str(r["text"] is None)) for r in f.collect() if r["doc_id"] is None or r["doc_id"] < 20)
    assert untouched(clean) == untouched(df)


def test_nothing_to_find(spark, docs, odd_rows):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.contaminated_spans(docs(odd_rows), bench).count() == 0
    assert D.contaminated_spans(docs(odd_rows), bench.limit(0)).count() == 0
    assert D.contaminated_spans(docs(odd_rows).limit(0), bench, ngram=1).count() == 0
    assert D.decontaminate(docs(odd_rows), bench.limit(0)).count() == len(odd_rows)


def test_merged():
    d, s, e, of = D.merged(np.array([1, 0, 0, 0]), np.array([5, 4, 0, 9]), np.array([9, 7, 4, 11]))
    assert (d.tolist(), s.tolist(), e.tolist(), of.tolist()) == ([0, 0, 1], [0, 9, 5], [7, 11, 9], [2, 0, 0, 1])


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_short_items_are_searched_whole(spark, docs, prose, limit):
    nine, five, long = prose(1, 9), prose(2, 5), prose(3, 20)
    bench = spark.createDataFrame([(1, nine), (2, five), (3, long), (4, "of the same kind"), (2, five)], "item_id long, text string")
    rows = [(1, f"so {nine} it goes"), (2, f"{five} {nine}"), (3, f"{long} {five.upper()}, of the same kind"), (4, " ".join(nine.split()[:8])), (5, "of the same kind")]
    spans = lambda **how: sorted((r["doc_id"], r["start_word"], r["n_words"], tuple(r["item_ids"])) for r in D.contaminated_spans(docs(rows), bench, broadcast_bytes=limit, **how).collect())
    assert spans() == [(1, 1, 9, (1,)), (2, 0, 14, (1, 2)), (3, 0, 25, (2, 3))]
    assert spans(shortest=4)[2:] == [(3, 0, 29, (2, 3, 4)), (5, 0, 4, (4,))] and spans(shortest=13) == [(3, 0, 20, (3,))]
    assert [r["text"] for r in D.decontaminate(docs(rows), bench, broadcast_bytes=limit).orderBy("doc_id").collect()] == ["so  it goes", "", ", of the same kind", rows[3][1], rows[4][1]]
