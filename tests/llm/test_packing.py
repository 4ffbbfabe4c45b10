import random
from collections import Counter, defaultdict
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import packing as P


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 40))
def test_closest_is_optimal(counts, room):
    chosen = P.closest(sorted(counts.items(), reverse=True), room)
    assert all(k <= counts[n] for n, k in chosen)
    best = max((s for s in (sum(n * k for n, k in zip(counts, ks)) for ks in product(*(range(c + 1) for c in counts.values()))) if s <= room), default=0)
    assert sum(n * k for n, k in chosen) == best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_plan_places_everything_once(counts):
    placed, windows = Counter(), 0
    for parts, first, times in P.plan(counts, 64):
        assert first == windows and times > 0 and sum(n * k for n, k in parts) <= 64
        windows += times
        placed.update({n: k * times for n, k in parts})
    assert placed == Counter(counts)
    assert windows <= len(list(counts)) + 2 * sum(n * c for n, c in counts.items()) / 64 + 1


def placements(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["window_id"]].append((r["position"], r["n_tokens"], r["doc_id"], r["first_token"]))
    return out


def check(rows, windows, capacity):
    assert sorted(windows) == list(range(len(windows)))
    pieces = defaultdict(list)
    for parts in windows.values():
        end = 0
        for at, n, doc, first in sorted(parts):
            assert at >= end and n > 0
            end = at + n
            pieces[doc].append((first, n))
        assert end <= capacity and end == sum(p[1] for p in parts)
    want = defaultdict(int)
    for d, n in rows:
        want[d] += n or 0
    assert {d: sum(n for _, n in ps) for d, ps in pieces.items()} == {d: n for d, n in want.items() if n}
    return pieces


def test_pack(spark):
    dice = random.Random(8)
    rows = [(d, dice.choice([0, 1, 5, 16, 17, 31, 32, 33, 64, 100, dice.randrange(1, 40)])) for d in range(400)] + [(7, 5), (7, 5), (None, 9), (None, 70), (900, None)]
    windows = placements(P.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 32))
    pieces = check(rows, windows, 32)
    for d, n in rows[:400]:
        if d != 7:
            assert sorted(pieces.get(d, [])) == [(k, min(32, n - k)) for k in range(0, n, 32)]
    assert len(windows) <= 1.02 * sum(n or 0 for _, n in rows) / 32 + 1
    assert P.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
    assert P.pack(spark.createDataFrame([(1, 64)], "doc_id long, n_tokens long"), 32).count() == 2


def test_lengths_and_odd_rows(docs, odd_rows):
    df = docs(odd_rows, "n_tokens window_id rest")
    lengths = P.token_lengths(df)
    got = {(r["doc_id"], r["n_tokens"]) for r in lengths.collect()}
    assert (1, 0) in got and (2, 0) in got and any(d == 5 and n >= 60_000 for d, n in got)
    check([tuple(r) for r in lengths.collect()], placements(P.pack(lengths)), P.CAPACITY)


def best_fill(lengths, room):
    """The largest sum of some of the lengths that isn't over room, by the set of all sums."""
    sums = {0}
    for n in lengths:
        sums |= {x + n for x in sums if x + n <= room}
    return max(sums)


def window_by_window(windows, capacity):
    """Each window holds the longest piece left, and fills up as far as any choice of those left could."""
    shared = [w for w in sorted(windows) if not (len(windows[w]) == 1 and windows[w][0][1] == capacity)]
    left = [n for w in shared for _, n, _, _ in windows[w]]
    for w in shared:
        own = [n for _, n, _, _ in windows[w]]
        assert max(own) == max(left)
        left.remove(max(left))
        assert sum(own) == max(own) + best_fill(left, capacity - max(own))
        own.remove(max(own))
        for n in own:
            left.remove(n)
    assert not left


def test_the_query_window_by_window(spark):
    """op6_packing as it is registered: every token of every document placed once, each window as full as it could be."""
    from tallyspark.llm import queries, tokens

    rows = [(r["doc_id"], len(tokens.ids(r["text"]))) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    windows = placements(queries.op6_packing(spark, "/root/testdata/sf0.001"))
    check(rows, windows, P.CAPACITY)
    window_by_window(windows, P.CAPACITY)


def test_one_length_that_most_rows_have(spark):
    df = spark.range(40_000).selectExpr("id AS doc_id", "CASE WHEN id % 50 = 0 THEN id % 90 + 1 ELSE 7 END AS n_tokens")
    out = P.pack(df, 64)
    assert out.count() == out.select("doc_id").distinct().count() + df.where("n_tokens > 64 AND n_tokens % 64 > 0").count()
    windows = out.groupBy("window_id").agg({"n_tokens": "sum", "position": "max"}).toPandas()
    assert windows["sum(n_tokens)"].max() <= 64 and len(windows) == windows["window_id"].max() + 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan and "rest" in plan
