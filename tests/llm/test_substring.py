import random

import numpy as np
import pyarrow as pa

from tallyspark.llm import substring as S
from tallyspark.llm import textnum as N


def test_automaton_gives_matching_statistics():
    dice = random.Random(3)
    for _ in range(150):
        known = [[dice.randrange(3) for _ in range(dice.randrange(1, 15))] for _ in range(dice.randrange(1, 5))]
        a = S.Automaton()
        for k in known:
            a.add(k)
        q = [dice.randrange(4) for _ in range(15)]
        has = lambda x: any(k[i : i + len(x)] == x for k in known for i in range(len(k)))
        assert a.matches(q) == [max(l for l in range(i + 2) if l == 0 or has(q[i + 1 - l : i + 1])) for i in range(len(q))]


def test_winnowing_hits_every_common_run():
    dice = random.Random(4)
    texts = [" ".join(f"a{dice.randrange(9)}" for _ in range(dice.randrange(0, 90))) for _ in range(30)]
    w = N.words(*N.utf8(pa.array(texts)))
    for gram, least in ((3, 8), (5, 5), (4, 9)):
        at, h = S.winnow(w, gram, least - gram + 1)
        chosen = set(at.tolist())
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            for i in range(a, b - least + 1):
                places = range(i, i + least - gram + 1)
                assert min(places, key=lambda p: h[p]) in chosen or any(p in chosen and h[p] == min(h[q] for q in places) for p in places)


def brute(rows, least):
    """Of each id, the words that lie in a run of `least` words that a smaller id has too."""
    out = {}
    for d, t in rows:
        ws, earlier = t.split(), [u.split() for e, u in rows if e < d]
        grams = {tuple(u[k : k + least]) for u in earlier for k in range(len(u) - least + 1)}
        hit = set()
        for k in range(len(ws) - least + 1):
            if tuple(ws[k : k + least]) in grams:
                hit |= set(range(k, k + least))
        if hit:
            out[d] = hit
    return out


def covered(spans):
    out = {}
    for r in spans.collect():
        mine = out.setdefault(r["doc_id"], set())
        new = set(range(r["start_word"], r["start_word"] + r["n_words"]))
        assert not mine & new
        mine |= new
    return out


def test_against_brute_force(docs, prose):
    dice = random.Random(5)
    pool = [prose(100 + k, 30).split() for k in range(12)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(dice.randrange(1, 6)):
            p = dice.choice(pool)
            a = dice.randrange(0, 15)
            words += p[a : a + dice.randrange(5, 30)] if dice.random() < 0.6 else prose(dice.random(), 12).split()
        rows.append((d, " ".join(words)))
    dice.shuffle(rows)
    for least, gram in ((12, 6), (10, 10)):
        assert covered(S.repeated_spans(docs(rows), min_words=least, gram=gram)) == brute(rows, least)


def test_odd_rows_and_removal(docs, odd_rows, prose):
    p = prose(9, 70)
    df = docs([*odd_rows, (30, f"a b {p} c"), (31, f"d {p.title()}, e"), (32, f"{p} {p}")], "fp shard low high")
    spans = S.repeated_spans(df)
    got = {(r["doc_id"], r["start_word"], r["n_words"]) for r in spans.collect()}
    assert got == {(7, 0, 80), (31, 1, 70), (32, 0, 140)}
    clean = {r["doc_id"]: r for r in S.remove_spans(df, spans).collect() if r["doc_id"] and r["doc_id"] > 6}
    assert clean[31]["text"] == "d , e" and clean[31]["n_chars"] == 5 and clean[32]["text"] == "" and clean[30]["text"].startswith("a b w") and clean[7]["text"] == ""
    assert S.remove_spans(df, spans).count() == df.count()
    assert S.repeated_spans(df.limit(0)).count() == 0
