"""Rendered files and graphs: plans that fit tables far larger than those they are made from."""

import pytest
from lodestone.operators import context, fixes, flows, graph, lexer, parse, symbols
from lodestone.plans import code
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rendered_files_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(code, "FILES", 10)
    files = code.code_files(spark, SF)
    assert files.rdd.getNumPartitions() >= files.count() // 10
    # Windows over a file's tokens need no shuffle of the tokens.
    assert plan(lexer.tokens(files)).count("Exchange hashpartitioning") == 1


def test_symbols_and_functions_read_tokens_once(spark):
    files = code.code_files(spark, SF)
    for text in (plan(symbols.nested_symbols(files)), plan(lexer.functions(lexer.tokens(files)))):
        assert "regexp_extract_all" not in text and "Broadcast" not in text


def test_symbols_shuffle_no_tokens(spark):
    text = plan(symbols.brace_symbols(code.code_files(spark, SF)))
    # The one exchange deals the rows that files are rendered from.
    assert text.count("Exchange") == 1 and "Exchange hashpartitioning(path" in text and "Join" not in text


def test_flows_write_few_tokens(spark, monkeypatch):
    rows, cut = [], flows.cut

    def counted(spark, frame, apart=False):
        out = cut(spark, frame, apart)
        rows.append(out.count())
        return out

    monkeypatch.setattr(flows, "cut", counted)
    files = code.code_files(spark, SF)
    flows.flow_graph(spark, files)
    assert max(rows) < lexer.tokens(files).count() / 2
    text = plan(flows.facts(files))
    assert text.count("Exchange") == 1 and "Join" not in text


def test_resolution_broadcasts_nothing_and_joins_on_bases(spark):
    files = code.typescript(spark, SF)
    text = plan(parse.resolve(parse.imports(files), files))
    assert "Broadcast" not in text and "SortMergeJoin" in text


@pytest.mark.parametrize("suffix", ["", ".ts", ".php", "/index.ts", "/index.php", "/__init__.py"])
def test_every_suffix_resolves_and_the_first_wins(spark, suffix):
    paths = spark.createDataFrame([(f"a/b{suffix}",), ("a/b/index.php",), ("a/b/__init__.py",)], "path string")
    found = spark.createDataFrame([("a/x.ts", "./b", False), ("a/x.ts", "./none", False)], "path string, source string, external boolean")
    want = [f"a/b{suffix}"] if suffix != "/__init__.py" else ["a/b/index.php"]
    assert [r.dst for r in parse.resolve(found, paths).collect()] == want


def test_entry_tree_broadcasts_nothing(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert "Broadcast" not in plan(graph.entry_tree(e, spark.createDataFrame([("a",)], "node string")))


def test_depths_of_layers_need_no_search_by_entry(spark, monkeypatch):
    monkeypatch.setattr(graph, "_depths_by_entry", None)
    e = spark.createDataFrame([(k, 100 + k % 3) for k in range(50)] + [(100, 200), (101, 200), (102, 201)], "src long, dst long")
    got = graph.depths(spark, e, e.where("src < 100").select(e.src.alias("node")))
    assert sorted((r.node, r.depth) for r in got.collect()) == [(100, 1), (101, 1), (102, 1), (200, 2), (201, 2)]


def test_depths_of_mixed_ways_and_nulls(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 3), (3, 4), (4, 3), (6, 7), (None, 7), (7, None)], "src long, dst long")
    got = graph.depths(spark, e, spark.createDataFrame([(1,), (5,), (6,), (None,)], "node long"))
    assert sorted((r.node, r.depth) for r in got.collect()) == [(2, 1), (3, 2), (4, 3), (7, 1)]


def test_openings_of_block_comments(spark):
    lines = {"/* a": True, "a /* b */ c": False, "a": False, "/ *": False, "x = \"/*\"": False, "/\"s\"* t": True, "a * b": False, "*/ /*": True}
    frame = spark.createDataFrame([(k,) for k in lines], "t string").select("t", context.opens_block(F.col("t")).alias("opens"))
    assert {r.t: r.opens for r in frame.collect()} == lines


def test_excerpts_broadcast_no_texts(spark):
    files = code.code_files(spark, SF)
    assert "Broadcast" not in plan(fixes.excerpt(files.selectExpr("path", "2 as line_no"), files, 1))


def test_regions_deal_tokens_once(spark):
    t = spark.createDataFrame([("a", i, x) for i, x in enumerate("({x}y)z")], "path string, i int, text string")
    regions = spark.createDataFrame([("a", 0, 5, 10), ("a", 1, 3, 11)], "path string, first int, last int, id int")
    got = flows.innermost(t, regions)
    text = plan(got)
    # One for the marks' sums, one for tokens and marks together.
    assert text.count("Exchange hashpartitioning") == 2 and "Join" not in text
    assert [r.region for r in got.orderBy("i").collect()] == [None, 10, 11, 10, 10, None, None]
