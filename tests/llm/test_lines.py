import random
from collections import Counter

import corpus_pipeline
from tallyspark.llm import lines as L
from tallyspark.llm import queries


def templates_by_loops(lines, share):
    """For the lines of a leaf, most frequent first, the line that started each one's template, token by token."""
    found, out = [], {}
    for line in lines:
        tokens = line.split()
        agree = [sum(t in ("<*>", own) for t, own in zip(pattern, tokens)) for pattern, _ in found]
        if agree and max(agree) >= share * len(tokens):
            pattern, start = found[agree.index(max(agree))]
            for k, own in enumerate(tokens):
                if pattern[k] != own:
                    pattern[k] = "<*>"
            out[line] = start
        else:
            found.append((tokens, line))
            out[line] = line
    return out


def brute(rows, depth=5, share=0.6, min_docs=6, min_tokens=1):
    """(id, text) with recurring templates dropped, by plain loops that share no code with the operator. Rows count by themselves."""
    mask = lambda line: " ".join("<*>" if any(c.isdigit() for c in t) else t for t in line.split(" "))
    usable = lambda m: m and len(m.split()) >= min_tokens
    of_row = [{m for m in (mask(x.strip(" \t\r\f\x0b")) for x in (t or "").split("\n")) if usable(m)} for _, t in rows]
    freq = Counter(m for ms in of_row for m in ms)
    leaves = {}
    for m in freq:
        toks = m.split()
        leaves.setdefault((len(toks), tuple(toks[:depth])), []).append(m)
    template = {}
    for ms in leaves.values():
        template |= templates_by_loops(sorted(ms, key=lambda m: (-freq[m], m)), share)
    seen = {}
    for k, ms in enumerate(of_row):
        for m in ms:
            seen.setdefault(template[m], set()).add(k)
    first = {t: min((rows[k][0] for k in ks if rows[k][0] is not None), default=None) for t, ks in seen.items()}
    out = []
    for d, t in rows:
        stays = lambda m: not usable(m) or len(seen[template[m]]) < min_docs or first[template[m]] == d
        out.append((d, t if t is None else "\n".join(x for x in t.split("\n") if stays(mask(x.strip(" \t\r\f\x0b"))))))
    return out


def test_grow():
    ls = ["user alice logged in from home now", "user bob logged in from home now", "user carol logged out at work today", "user dave logged in from work now"]
    assert L.grow(ls, 0.6) == [0, 0, 2, 0]
    assert L.grow(["a b", "a b c"][:1]) == [0] and L.grow([]) == []


def test_against_brute_force(docs, prose):
    dice = random.Random(6)
    names = [f"n{chr(97 + k)}" for k in range(20)]
    rows = []
    for d in range(60):
        ls = [prose(d, 9), "All rights reserved." if d % 3 else "  All rights reserved.", f"Page {d} of 60", "x"]
        if d % 4 == 0:
            ls.append(f"the report was written for customer {dice.choice(names)} on this day")
        if d % 20 == 0:
            ls.append("rare line here")
        dice.shuffle(ls)
        rows.append((d, "\n".join(ls) + ("\n\n" if d % 2 else "")))
    got = sorted((r["doc_id"], r["text"]) for r in L.line_dedup(docs(rows), min_tokens=2).collect())
    assert got == sorted(brute(rows, min_tokens=2))
    assert sum("written for customer" in t for _, t in got) == 1 and sum("rare line" in t for _, t in got) == 3 and sum("All rights" in t for _, t in got) == 1
    assert all("x" in t.split("\n") for _, t in got)


def test_odd_rows(docs, odd_rows):
    same = "one line that all of them share\nand another one"
    df = docs([*odd_rows, *((70 + k, same) for k in range(6)), (None, same), (80, same + "\nown text")], "dropped_lines line h g leaf df row text_ own_id DROP kept __id __drop __kept")
    out = L.line_dedup(df).collect()
    assert len(out) == df.count()
    rows = {}
    for r in out:
        rows.setdefault(r["doc_id"], []).append(r)
    assert rows[70][0]["text"] == same and rows[70][0]["dropped_lines"] == 0
    assert rows[71][0]["text"] == "" and rows[71][0]["n_chars"] == 0 and rows[71][0]["dropped_lines"] == 2
    assert rows[80][0]["text"] == "own text" and rows[80][0]["n_chars"] == 8
    assert sorted(r["text"] == "" for r in rows[None]) == [False, True]
    assert rows[1][0]["text"] is None and rows[5][0]["n_chars"] == 300_000 and rows[3][0]["text"] == " \n\t "
    extra = L.line_dedup(df)
    assert set(extra.columns) == {*df.columns} and dict(extra.dtypes)["kept"] == "string" and {r["DROP"] + r["__kept"] + r["own_id"] for r in out} == {"xxx"}
    assert L.line_dedup(df.limit(0)).count() == 0
    nobody = docs([(None, same)] * 7)
    assert L.line_dedup(nobody).where("text <> ''").count() == 7


def test_lines_of_one_token_in_the_queries(spark, docs, prose, tmp_path):
    rows = [(d, "\n".join(["Advertisement", prose(d, 9), f"p{d}", "Rare." if d < 5 else "x y", ""])) for d in range(12)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(brute(rows, min_tokens=1))
    assert sum("Advertisement" in t for _, t in want) == 1 and sum("Rare." in t for _, t in want) == 5
    for out in (queries.op3_line_dedup(spark, str(tmp_path)), corpus_pipeline.line_dedup(spark, docs(rows), str(tmp_path))):
        assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == want


def result(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_rows_count_alike_whatever_else_is_in_the_leaf(docs):
    cases = ([1] * 3 + [2] * 3, [9] + [None] * 6, [None] * 7, [1, 1, 2, 2, 3])
    rows = []
    for k, ids in enumerate(cases):
        for other in ("alone", "beside"):
            line = f"case {'abcd'[k]} {other} has this footer below every page"
            rows += [(i, line) for i in ids]
            if other == "beside":
                rows.append((50, f"case {'abcd'[k]} {other} has this or something else we wrote"))
    got = result(L.line_dedup(docs(rows)))
    assert got == sorted(brute(rows), key=str)
    assert sum(t == "" for _, t in got) == 2 * (3 + 6)


def test_one_leaf_with_many_templates(docs):
    dice = random.Random(4)
    rows = [(d, f"we have seen them all {dice.choice('abcdefgh')} {dice.choice('klmn')} {dice.choice('uvwxyz')} {dice.choice('opq')} {dice.choice('rst')} {dice.choice('12')} end") for d in range(150)]
    for share in (0.6, 0.9):
        assert result(L.line_dedup(docs(rows), similarity=share)) == sorted(brute(rows, share=share), key=str)


def test_the_query_over_the_documents(spark):
    """op3_line_dedup as it is registered, against plain loops over the whole table."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = result(queries.op3_line_dedup(spark, "/root/testdata/sf0.001"))
    assert got == sorted(brute(rows), key=str) and got != sorted(rows, key=str)
