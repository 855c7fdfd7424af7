"""The literal index against trying every rule on every line, and against plain Python."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from lodestone.operators import literal_index, scan, search
from lodestone.operators.scan import Rule
from lodestone.plans.catalogue import LINE_RULES, ROWS, SYNTAX_RULES
from lodestone.plans.code import document_files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("abc", {"abc"}),
        ("(?i)ABC|x(?:yz|YW)", {"abc", "xyz", "xyw"}),
        (r"\beval\s*\(", {"eval"}),
        (r"a?b+c", {"bc"}),
        (r"(?:foo)+bar", {"foobar"}),
        (r"\d{2,}px", {f"{d}{e}px" for d in range(10) for e in range(10)}),
        (r"[a-z]+", None),
        (r"foo|\w+", None),
        (r"(?:foo)?", None),
        (r"key[:=]\s*v", {"key:", "key="}),
        (r"abc|xabcx", {"abc"}),
        ("", None),
    ],
)
def test_needed_literals(pattern, want):
    assert literal_index.needed_literals(pattern) == want


def test_every_match_holds_a_literal():
    for rules in (LINE_RULES, SYNTAX_RULES):
        for r in rules:
            found = literal_index.needed_literals(r.pattern)
            for row in ROWS:
                for line in (row[6], row[7]):
                    if found and re.search(re.sub(r"\(\?i\)", "", r.pattern), line, re.IGNORECASE | re.ASCII):
                        assert any(t in line.lower() for t in found), (r.id, line)


def test_same_as_every_rule_on_every_line(spark):
    files = document_files(spark, SF)
    columns = ("path", "line_no", "text", "rule_id", "severity", "category", "confidence", "cwe")
    got = Counter(map(tuple, literal_index.scan_indexed(files, LINE_RULES).select(*columns).collect()))
    want = Counter(map(tuple, scan.scan_lines(files, LINE_RULES).select(*columns).collect()))
    assert got == want and len({r[3] for r in got}) == len(LINE_RULES)


def test_odd_files(spark):
    rules = [Rule("lit", "secret", "info", "security"), Rule("free", r"^\w$", "info", "security"), Rule("js", "x=", "info", "security", extensions=("js",)), Rule("no", "ab+c", "info", "security", exclude="skip")]
    files = spark.createDataFrame([("a.js", "İsecret\nx=\n\nq"), ("b", None), ("c.py", "x=\nSECRET secret"), ("d", ""), ("e", "abbc\nabc skip"), ("e", "abbc\nabc skip"), ("f.js", "x\r\nx=")], "path string, content string")
    got = sorted((r.path, r.line_no, r.rule_id) for r in literal_index.scan_indexed(files, rules).collect())
    assert got == [("a.js", 1, "lit"), ("a.js", 2, "js"), ("a.js", 4, "free"), ("c.py", 2, "lit"), ("e", 1, "no"), ("e", 1, "no"), ("f.js", 1, "free"), ("f.js", 2, "js")]
    assert literal_index.scan_indexed(files, []).count() == 0
    assert literal_index.scan_indexed(files.limit(0), rules).count() == 0


def test_texts_are_taken_in_parts():
    texts = ["a" * 400_000, None, "é" * 300_000, "b", "c" * 3_000_000, "", "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["content"])
    parts = [p.column(0).to_pylist() for p in literal_index._slices(batch, 0)]
    assert [t for p in parts for t in p] == texts and [len(p) for p in parts] == [3, 1, 1, 2]
    assert list(literal_index._slices(batch.slice(0, 0), 0)) == []


def grams(text):
    return Counter(text[i : i + 3] for i in range(len(text) - 2))


def test_postings_and_upsert(spark):
    draw = random.Random(3)
    texts = {f"p{k}": "".join(draw.choice("abAé😀 ") for _ in range(draw.randrange(60))) for k in range(80)}
    code = lambda g: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, content string")
    index = literal_index.postings(frame(texts | {"none": None}))
    rows = lambda t: sorted((p, code(g), n) for p, x in t.items() for g, n in grams(low(x)).items())
    assert sorted(map(tuple, index.collect())) == rows(texts)
    changed = {"p1": "aaaa", "p2": "", "new": "baab AAB"}
    index = literal_index.upsert(index, frame(changed), frame({"p3": "", "p4": ""}).select("path"))
    now = {p: t for p, t in (texts | changed).items() if p not in ("p3", "p4")}
    assert sorted(map(tuple, index.collect())) == rows(now)
    for literal in ("aab", "aaaa", "ABA", "é b", "zz", "b", "😀 a"):
        named = {r.path for r in literal_index.files_with(index, literal).collect()}
        assert named >= {p for p, t in now.items() if low(literal) in low(t) and len(t) > 2}
        got = literal_index.search_indexed(frame(now), index, literal).select("path", "line_no", "n").collect()
        assert sorted(got) == sorted(search.search(frame(now), literal).select("path", "line_no", "n").collect())
