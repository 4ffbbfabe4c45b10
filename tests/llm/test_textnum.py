import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import textnum as N

PUNCT = r"[!-/:-@\[-`{-~]"


def split(text):
    low = "".join(c.lower() if c.isascii() or ("À" <= c <= "Þ" and c != "×") else c for c in text)
    out = []
    for w in re.split(r"[ \t\n\r\f\v]+", re.sub(PUNCT, "", low)):
        out += [x for x in re.split("([　-￿\U00010000-\U0010ffff])", w) if x]
    return out


texts = st.lists(st.text(alphabet="aAbB ,.\n\té É日本🙂×-", max_size=30), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words(ts):
    data, offsets = N.utf8(pa.array(ts))
    w = N.words(data, offsets)
    want = [split(t) for t in ts]
    assert np.diff(w.first).tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    seen = {}
    for h, x in zip(w.hashes.tolist(), flat):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    for s, e, x in zip(w.start, w.end, flat):
        assert split(bytes(data[s:e]).decode()) == [x]


def test_slices_and_nulls():
    column = pa.array(["skip", None, "a b", ""]).slice(1)
    data, offsets = N.utf8(column)
    assert bytes(data) == b"a b" and offsets.tolist() == [0, 0, 3, 3]
    assert list(N.steps(np.array([0, 5, 5, 20, 21]), 6)) == [(0, 2), (2, 3), (3, 4)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 5))
def test_suffixes_and_grams(x, n):
    _, s = N.dense(np.array(x))
    levels = N.suffix_ranks(s)
    sa = N.suffix_array(levels[-1][1])
    assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
    assert (N.suffix_ranks(s, keep_all=False)[-1][1] == levels[-1][1]).all()
    for k, l in enumerate(N.neighbour_lcp(levels, sa).tolist()):
        a, b = x[sa[k] :], x[sa[k + 1] :]
        assert l == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    g = N.grams(N.mix(np.array(x).astype(np.uint64)), n).tolist()
    places = {}
    for k, h in enumerate(g):
        assert places.setdefault(tuple(x[k : k + n]), h) == h
    assert len(g) == max(0, len(x) - n + 1) and len(set(places.values())) == len(places)
