import numpy as np
import pyarrow as pa
import random

from tallyspark.llm import quality
from tallyspark.llm import textnum as N


def brute(words, least):
    n, covered, longest = len(words), set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        if best >= least:
            covered |= set(range(i, i + best))
            longest = max(longest, best)
    return n, len(covered), longest


def test_against_brute_force():
    dice = random.Random(1)
    texts = []
    for _ in range(120):
        words = [f"a{dice.randrange(6)}" for _ in range(dice.randrange(0, 60))]
        for _ in range(dice.randrange(3)):
            if len(words) > 12:
                k = dice.randrange(len(words) - 10)
                words[dice.randrange(len(words)) : 0] = words[k : k + 10]
        texts.append(" ".join(words))
    data, offsets = N.utf8(pa.array(texts))
    for least in (1, 3, 8):
        got = np.stack(quality.repeats(data, offsets, least), axis=1).tolist()
        assert [tuple(r) for r in got] == [brute(t.split(), least) for t in texts]


def test_rows_and_limits(docs, odd_rows, prose):
    df = docs([*odd_rows, (9, " ".join([prose(3, 40)] * 2)), (10, prose(4, 500) + " " + prose(5, 20) + " z " + prose(5, 20))], "n_words repeated_words")
    rows = {(r["doc_id"], r["n_words"]): r for r in quality.repetition(df).collect()}
    assert rows[5, 60_000]["longest_repeat"] == 59_999 and rows[5, 60_000]["repeated_fraction"] == 1.0
    assert rows[1, 0]["repeated_fraction"] == rows[2, 0]["repeated_fraction"] == rows[3, 0]["repeated_fraction"] == rows[4, 0]["repeated_fraction"] == 0.0
    assert rows[9, 80]["repeated_words"] == 80 and rows[9, 80]["longest_repeat"] == 40
    assert rows[10, 541]["repeated_words"] == 40 and rows[10, 541]["longest_repeat"] == 20
    kept = [r["doc_id"] for r in quality.quality_filter(df).collect()]
    assert sorted(kept, key=str) == sorted([1, None, 2, 3, 4, 6, 6, 7, 8, 10], key=str)
    assert quality.quality_filter(df, max_longest=19).where("doc_id = 10").count() == 0
    assert quality.quality_filter(df.limit(0)).count() == 0
