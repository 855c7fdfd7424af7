"""Spelling variants against pairs of words, one by one."""

import re
import zlib

import duckdb
import pytest
from lodestone.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, slip=199):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and mark % slip == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        others = sorted((-m, x) for x, m in words.items() if near(w, x))
        fits = others and -others[0][0] >= 5 * n
        out[w] = [others[0][1] if fits else None, w, n, len(others), -others[0][0] if fits else None]
    for w in out:
        end = w
        while out[end][0]:
            end = out[end][0]
        out[w][1] = end
    return sorted((w, *x) for w, x in out.items())


def got(spark, docs, **more):
    return sorted(tuple(r) for r in spelling.spelling_variants(spark, docs, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_forms_ties_and_roots(spark):
    text = " ".join(["banana"] * 5 + ["bananas"] * 25 + ["banunas"] * 140 + ["ÜberÄlt"] * 6 + ["ÜberÄlt"] * 30 + ["letters"] * 25 + ["lettera"] * 25 + ["letterz"] * 5 + ["aaaaaa"] * 5 + ["aaaaaaa"] * 25)
    rows = [(1, text), (2, None), (3, ""), (4, "x" * 70000), (5, "short words only"), (None, "planted " * 7), (1, "bananas"), (1, "bananas")]
    want = brute(rows)
    assert {w: r for w, _, r, *_ in want}["banana"] == "banunas"
    assert {w: f for w, f, *_ in want}["letterz"] == "lettera"
    assert got(spark, spark.createDataFrame(rows, "doc_id long, text string")) == want


@pytest.mark.parametrize("slip", [None, 2, 199])
def test_dense_vocabulary(spark, slip):
    import random

    draw = random.Random(7)
    words = ["".join(draw.choice("abé") for _ in range(draw.choice((6, 6, 7, 8)))) for _ in range(900)]
    rows = [(k, " ".join(draw.choices(words, weights=[1.5 ** (i % 20) for i in range(900)], k=1500))) for k in range(12)]
    assert got(spark, spark.createDataFrame(rows, "doc_id long, text string"), slip=slip) == brute(rows, slip)


def test_odd_rows(spark, odd, none):
    assert got(spark, odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert got(spark, none) == []


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = sorted(con.sql(spelling.SPELLING_SQL).fetchall())
    assert want and got(spark, spark.read.parquet(f"{sf}/documents.parquet")) == want
