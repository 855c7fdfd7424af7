"""Tokens, brackets and functions against a stack in plain Python."""

import random
import re

from lodestone.operators import lexer
from pyspark.sql import functions as F

TOKEN = re.compile(r"""(?P<space>[ \t\n\x0b\f\r]+)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\[\s\S]|[^`\\])*`?)|(?P<name>(?:[^\W\d]|\$)[\w$]*)|(?P<number>[0-9][A-Za-z0-9_.]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<sign>=>|[\s\S])""")


def brute(text):
    out, stack, pairs, line = [], [], [], 1
    for m in TOKEN.finditer(text):
        kind, t = m.lastgroup, m[0]
        if kind not in ("space", "comment"):
            i = len(out)
            if kind == "open":
                pairs.append([t, i, None, len(stack) + 1, stack[-1] if stack else None, line, None])
                stack.append(i)
            depth, lone = len(stack), False
            if kind == "close":
                lone = not stack
                if stack:
                    start = stack.pop()
                    p = next(p for p in pairs if p[1] == start)
                    p[2], p[6] = i, line
            out.append((i, line, kind, t, depth, lone))
        line += t.count("\n")
    return out, pairs


def check(spark, texts):
    files = spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)] + [("none", None), ("empty", "")], "path string, content string")
    tokens = lexer.tokens(files)
    got, pairs = {}, {}
    for r in tokens.collect():
        got.setdefault(r.path, []).append((r.i, r.line_no, r.kind, r.text, r.depth, r.lone))
    for r in lexer.brackets(tokens).collect():
        pairs.setdefault(r.path, []).append([r.sign, r.start, r.end, r.level, r.around, r.start_line, r.end_line])
    for k, t in enumerate(texts):
        want, want_pairs = brute(t)
        assert sorted(got.get(f"f{k}", [])) == want, t
        assert sorted(pairs.get(f"f{k}", []), key=lambda p: p[1]) == want_pairs, t


def test_random_texts(spark):
    draw = random.Random(11)
    signs = ["(", ")", "[", "]", "{", "}", "{", "(", "a", "b1", "=>", "=", "\n", " ", "'x(", "\"y{\"", "`t\n{`", "// c {\n", "/* ( */", "/*", "\\", "'", "12.5", ";", "é", "$x", "\""]
    check(spark, ["".join(draw.choice(signs) for _ in range(draw.randrange(80))) for _ in range(300)])


def test_documents_and_scripts(spark):
    sf = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 20000").select("text").limit(60).collect()]
    scripts = spark.read.parquet(f"{sf}/pages.parquet").select(F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("t"))
    check(spark, [t for t in texts if "\u0085" not in t] + [r.t for r in scripts.limit(80).collect()])


def test_functions(spark):
    text = """import x from 'y'
export async function load(id, opts = {}) {
  if (id) { return (a) => { return a } }
  const twice = async (n) => {
    function inner() { return [n] }
    return inner()
  }
  items.map(function (x) { return x })
}
class A extends B {
  run(q: string): void {
    for (const x of q) { y({ a: 1 }) }
  }
  get size() { return 1 }
}
const o = { go(a) { return a }, key: (b) => { return b } }
"""
    files = spark.createDataFrame([("a.ts", text)], "path string, content string")
    tokens = lexer.tokens(files)
    rows = lexer.functions(tokens).collect()
    names = {r.start: r.name for r in rows}
    got = sorted((r.start_line, r.end_line, r.name, names.get(r.inside)) for r in rows)
    assert got == [(2, 9, "load", None), (3, 3, "", "load"), (4, 7, "twice", "load"), (5, 5, "inner", "twice"), (8, 8, "", "load"), (11, 13, "run", None), (14, 14, "size", None), (16, 16, "go", None), (16, 16, "key", None)]
