"""Taint over scopes, calls and files, against a walk over the programs' own trees."""

import random

import pytest
from lodestone.operators import flows


def frame(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, content string")


def got(spark, files):
    return sorted(map(tuple, flows.taint_paths(spark, frame(spark, files)).select("path", "line_no", "kind", "source_path", "source_line").collect()))


def test_scopes_and_cleaners(spark):
    text = "\n".join(
        [
            "const id = req.query.id",
            "function shown(id) {",
            "  const q = id",
            "  db.query(q)",
            "}",
            "function unused(x) { return x }",
            "const safe = escape(id)",
            "db.query(safe)",
            "db.execute(id)",
            "const f = (a, b) => {",
            "  return b",
            "}",
            "const y = f(id, 1)",
            "const z = f(1, id)",
            "eval(y)",
            "eval(z); exec(escape(z)); exec(f(2, req.body))",
            "o.query = id; res.redirect(o)",
        ]
    )
    assert got(spark, {"a.js": text}) == [("a.js", 9, "sql", "a.js", 1), ("a.js", 16, "code", "a.js", 1), ("a.js", 16, "command", "a.js", 16)]


def test_over_files(spark):
    files = {
        "src/a.ts": "import { load, pass } from './b'\nload(req.params.id)\nconst v = pass(req.body)\nsend(v)",
        "src/b.ts": "export function load(id) {\n  db.query(id)\n}\nexport function pass(x) {\n  const y = inner(x)\n  return y\n}\nfunction inner(z) { return z }",
        "src/c.ts": "import { other } from './b'\nload(req.query.q)",
    }
    assert got(spark, files) == [("src/a.ts", 4, "page", "src/a.ts", 3), ("src/b.ts", 2, "sql", "src/a.ts", 2)]


def program(draw, n_files):
    """Random programs: their texts, and the flows as the generator knows them."""
    names = [(f"p/f{k}.js", [(f"g{k}x{j}", [f"a{j}", f"b{j}"][: draw.randint(1, 2)]) for j in range(draw.randint(1, 3))]) for k in range(n_files)]
    texts, edges, sites = {}, [], []
    for path, funcs in names:
        lines = []
        others = [(p, f) for p, fs in names if p != path for f in fs if draw.random() < 0.4]
        for p, f in others:
            lines.append(f"import {{ {f[0]} }} from './{p[2:-3]}'")
        known = {f[0]: (path, f) for f in funcs} | {f[0]: (p, f) for p, f in others}

        def value(scope, variables):
            """Text of a value, and the things that it holds."""
            kind = draw.random()
            if kind < 0.15:
                return "req.query.x", [("?", path, len(lines) + 1)]
            if kind < 0.6 or not known:
                v = draw.choice(variables)
                return v, [("v", *owner(scope, v), v)]
            if kind < 0.7:
                return f"escape({draw.choice(variables)})", []
            if kind < 0.8:
                return "1", []
            p, (f, ps) = known[draw.choice(sorted(known))]
            args = [value(scope, variables) for _ in ps]
            sites.append(None)
            site = ("c", path, len(sites))
            for q, (_, things) in zip(ps, args, strict=True):
                edges.extend(("down", x, ("v", p, f, q), site) for x in things)
            edges.append(("up", ("r", p, f), site, None))
            return f"{f}({', '.join(a for a, _ in args)})", [site]

        def owner(scope, v):
            return (path, scope) if scope and v in local else (path, "")

        tops = [f"t{k}" for k in range(3)]
        for scope, ps in [*funcs, ("", [])]:
            local = set(ps) | ({"t0", "m"} if scope and draw.random() < 0.5 else {"m"})
            if scope:
                lines.append(f"export function {scope}({', '.join(ps)}) {{")
            declared = set(ps)
            variables = sorted(set(tops) | local) if scope else tops
            for _ in range(draw.randint(2, 5)):
                kind = draw.random()
                text, things = value(scope, variables)
                if kind < 0.25:
                    sink, word = draw.choice([("sql", "db.query"), ("code", "eval"), ("command", "exec")])
                    edges.extend(("within", x, ("!", path, len(lines) + 1, sink), None) for x in things)
                    lines.append(f"{word}({text})")
                elif kind < 0.4 and scope:
                    edges.extend(("within", x, ("r", path, scope), None) for x in things)
                    lines.append(f"return {text}")
                else:
                    v = draw.choice(variables)
                    edges.extend(("within" if owner(scope, v)[1] == scope else "out", x, ("v", *owner(scope, v), v), None) for x in things)
                    lines.append(f"{'const ' if scope and v in local and v not in declared else ''}{v} = {text}")
                    declared.add(v)
            for v in sorted(local - declared):  # so that they are declared somewhere in their scope
                lines.append(f"let {v}")
            if scope:
                lines.append("}")
        texts[path] = "\n".join(lines)
    return texts, edges


@pytest.mark.parametrize("seed", range(4))
def test_random_programs(spark, seed):
    draw = random.Random(seed)
    files, edges = {}, []
    for k in range(5):
        t, e = program(draw, draw.randint(1, 3))
        files |= {f"d{k}/{p}": x for p, x in t.items()}
        moved = lambda n: n and (n[0], f"d{k}/{n[1]}", *n[2:])  # noqa: E731, B023
        edges += [(kind, moved(a), moved(b), moved(c)) for kind, a, b, c in e]
    within = {(a, b) for kind, a, b, _ in edges if kind == "within"}
    downs = [(a, b, c) for kind, a, b, c in edges if kind == "down"]
    result = {b: a for kind, a, b, _ in edges if kind == "up"}
    sums, grown = set(), True
    while grown:
        ways = {}
        for a, b in within | sums:
            ways.setdefault(a, set()).add(b)
        grown = False
        for a, param, call in downs:
            seen, stack = {param}, [param]
            while stack:
                for x in ways.get(stack.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        stack.append(x)
            if result[call] in seen and (a, call) not in sums:
                sums.add((a, call))
                grown = True
    near = {}
    for up in (True, False):
        for a, b in within | sums:
            near.setdefault((a, up), set()).add((b, up))
        for kind, a, b, _ in edges:
            if kind == "out" or kind == "up" and up:
                near.setdefault((a, up), set()).add((b, True))
            elif kind == "down":
                near.setdefault((a, up), set()).add((b, False))
    first = {}
    for s in sorted({a for _, a, _, _ in edges if a[0] == "?"}, key=lambda a: a[1:]):
        seen, stack = {(s, True)}, [(s, True)]
        while stack:
            for x in near.get(stack.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        for x, _ in seen:
            if x[0] == "!":
                first.setdefault(x, s)
    want = sorted((x[1], x[2], x[3], s[1], s[2]) for x, s in first.items())
    assert want and got(spark, files) == want, "\n\n".join(f"{p}\n{t}" for p, t in files.items())
