"""Queries over code that Spark renders from the given tables, and over documents as files; the same in SQL beside each.

`CODE` renders the files in SQL that Spark and DuckDB read alike, so both sides start from the same rows of the tables; what a query
finds in the rendered text is worked out in SQL from the tables' columns or by patterns, never listed.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import flows, graph, lexer, literal_index, parse, structure, symbols
from lodestone.plans.catalogue import GROUPS, LINE_RULES, ROWS
from lodestone.plans.queries import query
from lodestone.plans.rules import RULES
from lodestone.sources.tables import cut, shared_folder, table
from lodestone.streaming import rescan

# Documents as files ---------------------------------------------------------------------------------------------------


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Each document is a file of the language of one rule, and ends with that rule's two lines: the one it finds, and the near miss.
EXTENSIONS = [(GROUPS[r[3]] or ("txt",))[0] for r in ROWS]
_VALUES = ", ".join(f"({k}, {_sql(EXTENSIONS[k])}, {_sql(r[6])}, {_sql(r[7])})" for k, r in enumerate(ROWS))
_TAIL = f"tail AS (SELECT * FROM (VALUES {_VALUES}) t(k, ext, hit, miss))"
_FILES = f"{_TAIL}, files AS (SELECT source || '/d' || doc_id || '.' || ext AS path, ext, text || chr(10) || hit || chr(10) || miss AS content FROM documents JOIN tail ON doc_id % {len(ROWS)} = k)"
_FILE_LINES = f"{_FILES}, lines AS (SELECT path, ext, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no FROM files)"


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """path, content: the documents as files of the rules' languages."""
    tail = spark.createDataFrame([(k, EXTENSIONS[k], r[6], r[7]) for k, r in enumerate(ROWS)], "k long, ext string, hit string, miss string")
    docs = table(spark, sf, "documents").withColumn("k", F.col("doc_id") % len(ROWS)).join(F.broadcast(tail), "k")
    return docs.select(F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit("."), "ext").alias("path"), F.concat_ws("\n", "text", "hit", "miss").alias("content"))


def _rule_sql(k: int) -> str:
    r = LINE_RULES[k]
    ext = f"ext IN ({', '.join(map(_sql, r.extensions))}) AND " if r.extensions else ""
    no = f" AND NOT regexp_matches(text, {_sql(r.exclude)})" if r.exclude else ""
    return f"SELECT path, line_no, {_sql(r.id)} AS rule_id FROM lines WHERE {ext}regexp_matches(text, {_sql(r.pattern)}){no}"


ALL_RULES = f"WITH {_FILE_LINES}, found AS ({' UNION ALL '.join(map(_rule_sql, range(len(LINE_RULES))))})"


@query(f"{ALL_RULES} SELECT * FROM found")
def rules_indexed_scan(spark, sf):
    return literal_index.scan_indexed(document_files(spark, sf), LINE_RULES).select("path", "line_no", "rule_id")


@query(f"{ALL_RULES} SELECT rule_id, count(*) AS n, count(DISTINCT path) AS n_files, min(path) AS first_path FROM found GROUP BY rule_id")
def rules_indexed_totals(spark, sf):
    found = literal_index.scan_indexed(document_files(spark, sf), LINE_RULES)
    return found.groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"), F.min("path").alias("first_path"))


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GRAM = "unicode(substr(t, i, 1)) * 4398046511104 + unicode(substr(t, i + 1, 1)) * 2097152 + unicode(substr(t, i + 2, 1))"
_POSTINGS = f"postings AS (SELECT path, gram, count(*)::INT AS n FROM (SELECT path, ({_GRAM})::BIGINT AS gram FROM (SELECT path, t, unnest(range(1, length(t) - 1)) AS i FROM texts)) GROUP BY path, gram)"


def _document_postings(spark: SparkSession, sf: str) -> DataFrame:
    return literal_index.postings(table(spark, sf, "documents"), "doc_id", "text")


@query(f"WITH texts AS (SELECT doc_id::VARCHAR AS path, {_LOW} AS t FROM documents), {_POSTINGS} SELECT gram, count(*) AS n_files, sum(n)::BIGINT AS n FROM postings GROUP BY gram")
def trigram_totals(spark, sf):
    return _document_postings(spark, sf).groupBy("gram").agg(F.count("*").alias("n_files"), F.sum("n").cast("long").alias("n"))


@query(f"WITH texts AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 = 3 THEN upper(lang) || ' ' || {_LOW.replace('text,', 'lower(substr(text, 1, 200)),')} ELSE {_LOW} END AS t FROM documents WHERE doc_id % 10 <> 7), low AS (SELECT path, {_LOW.replace('text,', 't,')} AS t FROM texts), {_POSTINGS.replace('texts', 'low')} SELECT path, count(*) AS n_grams, sum(n)::BIGINT AS n, sum(gram % 1000003)::BIGINT AS digest FROM postings GROUP BY path")
def trigrams_upserted(spark, sf):
    d = table(spark, sf, "documents")
    changed = d.where("doc_id % 10 = 3").select("doc_id", F.concat(F.upper("lang"), F.lit(" "), F.lower(F.substring("text", 1, 200))).alias("text"))
    index = literal_index.upsert(_document_postings(spark, sf), changed, d.where("doc_id % 10 = 7").select("doc_id"), "doc_id", "text")
    return index.groupBy("path").agg(F.count("*").alias("n_grams"), F.sum("n").cast("long").alias("n"), F.sum(F.col("gram") % 1000003).alias("digest"))


_DOC_LINES = "lines AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM documents)"


@query(f"WITH {_DOC_LINES} SELECT path, line_no, len(regexp_extract_all(text, '(?i)license, version', 0))::BIGINT AS n FROM lines WHERE regexp_matches(text, '(?i)license, version')")
def search_by_index(spark, sf):
    return literal_index.search_indexed(table(spark, sf, "documents"), _document_postings(spark, sf), "License, Version", "doc_id", "text").select("path", "line_no", "n")


# Code rendered from parts ---------------------------------------------------------------------------------------------

#: Each part is a TypeScript file: a class with p_size % 4 methods, a function `keep<key>` that gives back its first parameter, the same cleaned, its second
#: one or a number (by p_partkey % 5), and `run<key>`, which sends a request's value through `keep` of another part's file into a query.
_PARTS = "parts AS (SELECT p_partkey AS k, p_partkey % 5 AS t, p_size % 4 AS n, (p_partkey * 7 + p_size) % (SELECT count(*) FROM part) AS q, 'src/p' || p_partkey || '.ts' AS path FROM part)"


#: Files for a task. A part's row is a few bytes in its table and makes some hundred tokens, so splits by size of the table are much too large.
FILES = 5_000


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """path, content of the parts' files, dealt by path."""
    part = table(spark, sf, "part")
    total = part.count()
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(total / FILES))
    part = part.withColumn("path", F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".ts"))).repartition(tasks, "path")
    k, q = F.col("p_partkey").cast("string"), ((F.col("p_partkey") * 7 + F.col("p_size")) % total).cast("string")
    t, n = F.col("p_partkey") % 5, (F.col("p_size") % 4).cast("int")
    none = F.array().cast("array<string>")
    methods = F.flatten(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda m: F.array(F.concat(F.lit("  m"), m.cast("string"), F.lit("(tax) {")), F.concat(F.lit('    const total = [tax, "'), "p_type", F.lit(' ("]')), F.lit("  }"))))
    held = F.when(t.isin(0, 1), "value").when(t == 2, "escape(value)").when(t == 3, "other").otherwise("1")
    head = F.array(F.concat(F.lit("import { keep"), q, F.lit(" } from './p"), q, F.lit("'")), F.concat(F.lit("// "), "p_name", F.lit(" {{ not code")), F.concat(F.lit("export class Part"), k, F.lit(" {")))
    tail = F.array(
        F.lit("}"),
        F.concat(F.lit("export function keep"), k, F.lit("(value, other) {")),
        F.concat(F.lit("  const held = "), held),
        F.lit("  return held"),
        F.lit("}"),
        F.concat(F.lit("function run"), k, F.lit("(req) {")),
        F.lit("  const id = req.query.id"),
        F.concat(F.lit("  const moved = keep"), q, F.lit("(id, 1)")),
        F.lit("  const use = () => {"),
        F.lit("    db.query(moved)"),
        F.lit("  }"),
        F.lit("  return use"),
        F.lit("}"),
    )
    return part.select("path", F.array_join(F.concat(head, F.coalesce(methods, none), tail), "\n").alias("content"))


@query(f"WITH {_PARTS} SELECT path, (10 + 3 * n + CASE WHEN t = 2 THEN 1 ELSE 0 END)::BIGINT AS pairs, 3 AS deepest FROM parts")
def code_brackets(spark, sf):
    pairs = lexer.brackets(lexer.tokens(code_files(spark, sf)))
    return pairs.where("end is not null").groupBy("path").agg(F.count("*").alias("pairs"), F.max("level").alias("deepest"))


_FUNCTIONS = f"""{_PARTS}, functions AS (
  SELECT path, 'm' || m AS name, 1 + 3 * m AS start_line, 3 + 3 * m AS end_line, NULL AS inside, 'Part' || k AS parent FROM (SELECT *, unnest(range(1, n + 1)) AS m FROM parts)
  UNION ALL SELECT path, 'keep' || k, 5 + 3 * n, 8 + 3 * n, NULL, NULL FROM parts
  UNION ALL SELECT path, 'run' || k, 9 + 3 * n, 16 + 3 * n, NULL, NULL FROM parts
  UNION ALL SELECT path, 'use', 12 + 3 * n, 14 + 3 * n, 'run' || k, 'run' || k FROM parts)"""


@query(f"WITH {_FUNCTIONS} SELECT path, name, start_line::INT AS start_line, end_line::INT AS end_line, inside FROM functions")
def code_functions(spark, sf):
    found = lexer.functions(lexer.tokens(code_files(spark, sf)))
    outer = found.select("path", F.col("start").alias("inside"), F.col("name").alias("holder"))
    return found.join(outer, ["path", "inside"], "left").select("path", "name", "start_line", "end_line", F.col("holder").alias("inside"))


@query(f"WITH {_FUNCTIONS} SELECT path, 'function' AS kind, name, start_line::INT AS start_line, end_line::INT AS end_line, parent, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS depth FROM functions UNION ALL SELECT path, 'class', 'Part' || k, 3, (4 + 3 * n)::INT, NULL, 0 FROM parts")
def code_symbols(spark, sf):
    return symbols.nested_symbols(code_files(spark, sf))


@query(f"WITH {_PARTS} SELECT a.path, (13 + 3 * a.n)::INT AS line_no, 'sql' AS kind, a.path AS source_path, (10 + 3 * a.n)::INT AS source_line FROM parts a JOIN parts b ON b.k = a.q WHERE b.t IN (0, 1)")
def code_taint(spark, sf):
    return flows.taint_paths(spark, code_files(spark, sf))


def typescript(spark: SparkSession, sf: str) -> DataFrame:
    return code_files(spark, sf).withColumn("language", F.lit("typescript"))


#: Each part also has a file in Python, Go, Rust or TSX, by p_partkey % 4: with packages and files of its own imported, classes with bases and interfaces, and things that are exported by default or not at all.
_MORE = """more AS (SELECT p_partkey AS k, p_partkey % 4 AS t, 'more/p' || p_partkey || ['.py', '.go', '.rs', '.tsx'][1 + p_partkey % 4] AS path FROM part)"""
_TEXTS = (
    ("python", ".py", "import os\nfrom flask import Flask, g as G\nfrom .m@ import Base\n\nclass Part@(Base):\n    pass\n\ndef make@():\n    return 1\n\ndef _own():\n    return 2"),
    ("go", ".go", 'package main\n\nimport "fmt"\n\nfunc Run@() {\n}\n\nfunc own() {\n}'),
    ("rust", ".rs", "use crate::p@;\n\npub fn area@() {}\npub struct Shape@ {}\nfn own() {}"),
    ("typescript", ".tsx", "import React, { useState as S } from 'react'\nimport type { Q } from './q'\nabstract class Box@ extends Base implements Closable, Open {\n}\nexport default function Page@() {\n}\nexport const Button@ = 1\nexport type T@ = string"),
)


def several_languages(spark: SparkSession, sf: str) -> DataFrame:
    """path, content, language: the parts' TypeScript files and their files in four languages."""
    k = F.col("p_partkey")
    which = lambda j: F.get(F.array(*(F.lit(x[j]) for x in _TEXTS)), (k % 4).cast("int"))
    name = k.cast("string")
    more = table(spark, sf, "part").select(F.concat(F.lit("more/p"), name, which(1)).alias("path"), F.replace(which(2), F.lit("@"), name).alias("content"), which(0).alias("language"))
    return typescript(spark, sf).unionByName(more)


@query(
    f"WITH {_PARTS}, {_MORE} SELECT path, 'keep' || k AS name, 'function' AS kind, false AS is_default FROM parts UNION ALL SELECT path, 'Part' || k, 'class', false FROM parts"
    " UNION ALL SELECT path, x.name || k, x.kind, x.is_default FROM more JOIN (VALUES (0, 'make', 'function', false), (0, 'Part', 'class', false), (1, 'Run', 'function', false), (2, 'area', 'function', false), (2, 'Shape', 'function', false), (3, 'Page', 'component', true), (3, 'Button', 'component', false), (3, 'T', 'type', false)) x(m, name, kind, is_default) ON m = t"
)
def exports_table(spark, sf):
    return structure.exports(several_languages(spark, sf)).select("path", "name", "kind", "is_default")


@query(
    f"WITH {_PARTS}, {_MORE} SELECT path, './p' || q AS source, false AS external FROM parts"
    " UNION ALL SELECT path, CASE WHEN own THEN source || k ELSE source END, external FROM more JOIN (VALUES (0, 'os', false, true), (0, 'flask', false, true), (0, '.m', true, false), (1, 'fmt', false, true), (2, 'crate::p', true, false), (3, 'react', false, true), (3, './q', false, false)) x(m, source, own, external) ON m = t"
)
def import_sources(spark, sf):
    return parse.imports(several_languages(spark, sf))


@query(f"WITH {_PARTS} SELECT path AS src, 'src/p' || q || '.ts' AS dst FROM parts WHERE k <> q")
def import_edges(spark, sf):
    files = typescript(spark, sf)
    return parse.resolve(parse.imports(files), files)


@query(f"WITH {_PARTS} SELECT 'src/p' || q || '.ts' AS node, count(*) AS importers FROM parts WHERE k <> q GROUP BY q HAVING count(*) > 1")
def imported_often(spark, sf):
    files = typescript(spark, sf)
    return graph.degrees(parse.resolve(parse.imports(files), files)).where("in_deg > 1").select("node", F.col("in_deg").alias("importers"))


# Graphs of orders -----------------------------------------------------------------------------------------------------


@query()
def order_part_connectors(spark, sf):
    """Orders and parts whose removal would split the graph of who ordered what. The answer by brute force is in the tests."""
    items = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    return graph.connectors(spark, items, apart=True)


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN supplier x ON x.s_suppkey = a.l_suppkey JOIN supplier y ON y.s_suppkey = b.l_suppkey WHERE x.s_nationkey = y.s_nationkey AND a.l_suppkey <> b.l_suppkey AND a.l_quantity < b.l_quantity AND a.l_extendedprice > b.l_extendedprice),"
    " r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT x.src AS node, max(x.dst) AS component FROM r x JOIN r y ON y.src = x.dst AND y.dst = x.src GROUP BY x.src HAVING count(*) > 1"
)
def supplier_cycles(spark, sf):
    """Suppliers of a nation that follow each other in orders, by more for less, round in circles."""
    i = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "l_suppkey", "s_nationkey", "l_quantity", "l_extendedprice")
    after = i.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("dst"), "s_nationkey", F.col("l_quantity").alias("more"), F.col("l_extendedprice").alias("less"))
    pairs = i.join(after, ["l_orderkey", "l_linenumber", "s_nationkey"]).where("l_quantity < more and l_extendedprice > less")
    return graph.strong_components(spark, pairs.select(F.col("l_suppkey").alias("src"), "dst"))


@query(
    "SELECT 'p' || l_partkey AS node, 1::BIGINT AS depth FROM lineitem GROUP BY l_partkey UNION ALL SELECT 's' || l_suppkey, 2 FROM lineitem GROUP BY l_suppkey UNION ALL SELECT DISTINCT 'n' || s_nationkey, 3 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey UNION ALL SELECT DISTINCT 'r' || n_regionkey, 4 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"
)
def depths_from_orders(spark, sf):
    """How far parts, suppliers, nations and regions are from all orders at once."""
    i, s, n = table(spark, sf, "lineitem"), table(spark, sf, "supplier"), table(spark, sf, "nation")
    edge = lambda d, a, x, b, y: d.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    edges = edge(i, "o", "l_orderkey", "p", "l_partkey").unionByName(edge(i, "p", "l_partkey", "s", "l_suppkey")).unionByName(edge(s, "s", "s_suppkey", "n", "s_nationkey")).unionByName(edge(n, "n", "n_nationkey", "r", "n_regionkey"))
    return graph.depths(spark, edges, i.select(F.concat(F.lit("o"), "l_orderkey").alias("node")))


# Changes that a stream follows ----------------------------------------------------------------------------------------

_TEXT_RULES = " UNION ALL ".join(f"SELECT path, line_no, {_sql(r.id)} AS rule_id FROM lines WHERE regexp_matches(text, {_sql(r.pattern)})" + (f" AND NOT regexp_matches(text, {_sql(r.exclude)})" if r.exclude else "") for r in RULES)


@query(
    "WITH final AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 = 0 THEN replace(text, '@', ' at ') || chr(10) || 'token = \"' || source || '\"' ELSE text END AS content FROM documents WHERE doc_id % 7 <> 0),"
    f" lines AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no FROM final) {_TEXT_RULES}"
)
def rescan_followed(spark, sf):
    """Documents as files of which some change and some go: a stream of the versions, with findings as state, run to its end."""
    # As a pattern, since a stream takes a path without one for a folder.
    docs = spark.readStream.schema(table(spark, sf, "documents").schema).parquet(f"{sf}/documents.parque[t]")
    version = lambda n, content, when: F.when(when, F.struct(F.lit(n).cast("long").alias("version"), content.alias("content")))
    changed = F.concat(F.replace("text", F.lit("@"), F.lit(" at ")), F.lit('\ntoken = "'), "source", F.lit('"'))
    versions = F.array_compact(F.array(version(1, F.col("text"), F.lit(True)), version(2, changed, F.col("doc_id") % 5 == 0), version(3, F.lit(None).cast("string"), F.col("doc_id") % 7 == 0)))
    changes = docs.select(F.col("doc_id").cast("string").alias("path"), F.explode(versions).alias("v")).select("path", "v.version", "v.content")
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/rescan-{uuid.uuid4().hex}"
    return rescan.net(rescan.run_to_end(spark, rescan.follow(changes, RULES), folder))
