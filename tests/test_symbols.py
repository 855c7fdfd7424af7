"""Ranges and parents of symbols, language by language, and against plain stacks."""

import random

import pytest
from lodestone.operators import symbols

FILES = {
    "a.ts": ("export class A extends B {\n  run(q: string): void {\n    const f = (x) => {\n      return x\n    }\n  }\n}\ninterface I { a: number }\nenum E { A, B }\nfunction g() { return 1 }", {("class", "A", 1, 7, None, 0), ("function", "run", 2, 6, "A", 1), ("function", "f", 3, 5, "run", 2), ("interface", "I", 8, 8, None, 0), ("enum", "E", 9, 9, None, 0), ("function", "g", 10, 10, None, 0)}),
    "b.go": ("package m\ntype S struct {\n}\nfunc (s *S) Get(a int) (int, error) {\n  return 1, nil\n}\nfunc main() {\n  x := func() { y() }\n}", {("function", "Get", 4, 6, None, 0), ("function", "main", 7, 9, None, 0)}),
    "c.rs": ("struct P { a: u8 }\nimpl P {\n  pub fn new(a: u8) -> Self {\n    P { a }\n  }\n}\ntrait T { fn t(&self) -> u8; }\nfn main() {}", {("struct", "P", 1, 1, None, 0), ("impl", "P", 2, 6, None, 0), ("function", "new", 3, 5, "P", 1), ("trait", "T", 7, 7, None, 0), ("function", "main", 8, 8, None, 0)}),
    "d.java": ("public class D {\n  private int n;\n  public D(int n) {\n    this.n = n;\n  }\n  static class Inner {\n    int get() { return 1; }\n  }\n}", {("class", "D", 1, 9, None, 0), ("function", "D", 3, 5, "D", 1), ("class", "Inner", 6, 8, "D", 1), ("function", "get", 7, 7, "Inner", 2)}),
    "e.kt": ("class K(val a: Int) {\n  fun f(x: Int): Int {\n    return x\n  }\n}\nobject O { fun g() { } }", {("class", "K", 1, 5, None, 0), ("function", "f", 2, 4, "K", 1), ("object", "O", 6, 6, None, 0), ("function", "g", 6, 6, "O", 1)}),
    "f.cs": ("namespace N {\n  class C {\n    void M() { if (x) { y(); } }\n  }\n}", {("namespace", "N", 1, 5, None, 0), ("class", "C", 2, 4, "N", 1), ("function", "M", 3, 3, "C", 2)}),
    "g.php": ("<?php\nclass P {\n  function f($a) { return $a; }\n}\nfunction top() { }", {("class", "P", 2, 4, None, 0), ("function", "f", 3, 3, "P", 1), ("function", "top", 5, 5, None, 0)}),
    "h.cpp": ("struct S {\n  int a;\n};\nint main(int argc) {\n  for (;;) { }\n}", {("struct", "S", 1, 3, None, 0), ("function", "main", 4, 6, None, 0)}),
    "i.swift": ("protocol Q { }\nclass W {\n  func f(a: Int) -> Int { return a }\n}", {("protocol", "Q", 1, 1, None, 0), ("class", "W", 2, 4, None, 0), ("function", "f", 3, 3, "W", 1)}),
    "j.py": ("import os\nclass A:\n    def f(self):\n        return 1\n\n    async def g(self):\n        def h():\n            pass\n        # note\n\n    x = 1\ndef top(): pass\nclass B: pass\n", {("class", "A", 2, 11, None, 0), ("function", "f", 3, 4, "A", 1), ("function", "g", 6, 8, "A", 1), ("function", "h", 7, 8, "g", 2), ("function", "top", 12, 12, None, 0), ("class", "B", 13, 13, None, 0)}),
    "k.js": ("const o = { a() { return 1 } }\nclass Z { get b() { return 2 } static c() { } }", {("function", "a", 1, 1, None, 0), ("class", "Z", 2, 2, None, 0), ("function", "b", 2, 2, "Z", 1), ("function", "c", 2, 2, "Z", 1)}),
}


def rows(spark, files):
    got = {}
    for r in symbols.nested_symbols(spark.createDataFrame(sorted(files.items()), "path string, content string")).collect():
        got.setdefault(r.path, []).append((r.kind, r.name, r.start_line, r.end_line, r.parent, r.depth))
    return got


def test_languages(spark):
    got = rows(spark, {p: t for p, (t, _) in FILES.items()} | {"none.py": "", "x.txt": "class A { }"})
    for path, (_, want) in FILES.items():
        assert set(got[path]) == want and len(got[path]) == len(want), path
    assert set(got) == set(FILES)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_nesting(spark, seed):
    draw = random.Random(seed)
    files, want = {}, {}
    for k in range(25):
        for ext in ("py", "ts"):
            path, lines, out = f"f{k}.{ext}", [], []

            def put(depth, parent, room, lines=lines, out=out, ext=ext, k=k):
                for j in range(draw.randint(1, 3)):
                    pad = "  " * depth
                    if draw.random() < 0.4 and room:
                        kind = draw.choice(("class", "function"))
                        name = f"n{len(out)}"
                        head = {"py": f"{'class' if kind == 'class' else 'def'} {name}{'' if kind == 'class' else '(a)'}:", "ts": f"class {name} {{" if kind == "class" else f"function {name}(a) {{"}[ext]
                        lines.append(pad + head)
                        at, start = len(out), len(lines)
                        out.append(None)
                        put(depth + 1, name, room - 1)
                        if ext == "ts":
                            lines.append(pad + "}")
                        end = len(lines)
                        while not lines[end - 1].strip():
                            end -= 1
                        out[at] = (kind, name, start, end, parent, depth)
                    else:
                        lines.append(pad + draw.choice(("x = 1", "call(y)", "z = [1, 2]")))
                        if draw.random() < 0.3:
                            lines.append("")

            put(0, None, 4)
            files[path] = "\n".join(lines)
            want[path] = sorted(out, key=str)
    got = rows(spark, files)
    for path in files:
        assert sorted(got.get(path, []), key=str) == want[path], files[path]
