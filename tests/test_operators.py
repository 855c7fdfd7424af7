import datetime as dt

import zipfile

from lodestone.functions.fuzzy import fuzzy_match
from lodestone.functions.text import entropy, glob_filter, normalize_path, search_pattern, strip_version
from lodestone.operators import compare, graph, history, report, scan, search
from lodestone.sources import repo
from lodestone.streaming import events as streams
from pyspark.sql import functions as F


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_search_pattern():
    assert search_pattern("  ") is None
    assert search_pattern("a.b", case_sensitive=True) == r"a\.b"
    assert search_pattern("[", regex=True) == r"(?i)\["
    assert search_pattern("x", whole_word=True) == r"(?i)\bx\b"


def test_lines_and_context(spark):
    f = spark.createDataFrame([("a", "one\ntwo\nthree\n"), ("b", ""), ("c", None)], "path string, content string")
    assert values(search.to_lines(f), "path", "line_no") == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1), ("c", 1)]
    hits = search.search(f, "T", case_sensitive=False)
    assert values(hits, "path", "line_no", "n") == [("a", 2, 1), ("a", 3, 1)]
    assert values(search.line_context(f, "w", 1, 1), "hit_line", "line_no", "text") == [(2, 1, "one"), (2, 2, "two"), (2, 3, "three")]
    assert values(search.search_partial(f, "one")[1], "path") == [("b",), ("c",)]
    assert search.search(f, " ").count() == 0


def test_patterns_bound_to_lines(spark):
    """Anchors and the like hold for lines, whatever the other lines of a text are."""
    text = "a motion\nbar one\nx\ny\r\n\nlast foo\n"
    f = spark.createDataFrame([("a", text), ("b", "foo")], "path string, content string")
    for query, want in (("tion$", [1]), ("(?:^a|zz)", [1]), ("^$", [5, 7]), (r"\r$", [4]), (r"e\Z", [2]), (r"\Ab", [2]), ("x(?!\\s)", [3]), ("x[^y]*+$", [3]), ("[^$^]tion", [1]), (r"\\Z|one", [2])):
        got = search.search(f.where("path = 'a'"), query, regex=True, case_sensitive=True)
        assert [r.line_no for r in got.orderBy("line_no").collect()] == want, query
    rules = [scan.Rule("end", "one$", "info", "style"), scan.Rule("start", "^last", "info", "style")]
    assert values(scan.scan_lines(f, rules), "path", "line_no", "rule_id") == [("a", 2, "end"), ("a", 6, "start")]
    assert [search.whole_text(p) for p in ("[#*$%&]{3,}", r"(?i)\bthe\b", r"a\$", "a$", "(?m)a|^b", r"\Aa", "[a]$", "(?<=a)b", r"\\\\A")] == [True, True, True, False, False, False, False, False, True]


def test_upsert(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    new = spark.createDataFrame([("a", "9", False), ("b", None, True), ("c", "3", False)], "path string, content string, removed boolean")
    assert values(search.upsert(base, new), "path", "content") == [("a", "9"), ("c", "3")]


def test_text_functions(spark):
    d = spark.createDataFrame([("a/./b/../c", "^1.2", "aabb"), ("../x", ">=3", "")], "p string, v string, s string")
    got = d.select(normalize_path(F.col("p")).alias("p"), strip_version(F.col("v")).alias("v"), entropy(F.col("s")).alias("e")).collect()
    assert [(r.p, r.v, r.e) for r in got] == [("a/c", "1.2", 1.0), ("x", "3", 0.0)]
    assert [r[0] for r in d.select(glob_filter(F.col("p"), "*.x, ../*")).collect()] == [False, True]


def test_fuzzy(spark):
    def of(query, text):
        m = spark.range(1).select(fuzzy_match(query, F.lit(text)).alias("m")).first().m
        return (m.score, m.places) if m.ok else None

    assert of("zz", "abc") is None
    assert of("ab", "ab") == (10 + 5 + 1 + 10 + 1, [0, 1])
    assert of("b", "a/b") == (1 + 5 + 1, [2])
    assert of("B", "a/b" + "x" * 20) == (1 + 5 - 1, [2])
    assert of("", "abc") == (0, [])


def test_scores_and_grades(spark):
    rules = [scan.Rule("a", "bad", "critical", "security", "high", "CWE-1"), scan.Rule("b", "odd", "info", "style", "low")]
    f = spark.createDataFrame([("x", "bad\nodd odd\nfine"), ("y", "fine")], "path string, content string")
    i = scan.scan_lines(f, rules)
    assert values(i, "path", "line_no", "rule_id") == [("x", 1, "a"), ("x", 2, "b")]
    assert values(scan.score(i), "rule_id", "risk_score") == [("a", 10.0), ("b", 1.0)]
    assert values(scan.lower_confidence(i, F.lit(True)), "rule_id", "confidence") == [("a", "medium"), ("b", "low")]
    g = scan.grades(scan.summary(i, []), F.lit(4)).first()
    assert (g.points, g.grade, g.quality) == (35, "F", "F")
    capped, over = scan.cap_rules(spark.createDataFrame([("p", k, "r") for k in range(20)], "path string, line_no int, rule_id string"))
    assert capped.count() == 15 and values(over, "rule_id", "overflow") == [("r", 5)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (7, 8)], "src long, dst long")
    assert values(graph.components(spark, e), "node", "component") == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)]
    assert values(graph.depths(spark, e, spark.createDataFrame([(4,)], "node long")), "node", "depth") == [(1, 2), (2, 3), (3, 1)]
    assert values(graph.two_cycles(spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")), "a", "b") == [(1, 2)]
    assert values(graph.unreferenced(spark.range(1, 9).withColumnRenamed("id", "node"), e), "node") == [(4,), (5,), (6,), (7,)]
    chain = spark.createDataFrame([(k, k + 1) for k in range(12)], "src long, dst long")
    assert {r.component for r in graph.components(spark, chain).collect()} == {0}
    assert graph.components(spark, e.limit(0)).count() == 0


def test_depths_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(60, 55)], "src long, dst long")
    assert values(graph.depths(spark, chain, spark.createDataFrame([(0,)], "node long")), "node", "depth") == [(k, k) for k in range(1, 61)]


def test_sessions(spark):
    t = dt.datetime(2024, 1, 7, 12)
    c = spark.createDataFrame([("a", t), ("a", t + dt.timedelta(minutes=119)), ("a", t + dt.timedelta(minutes=239)), ("b", t)], "author string, ts timestamp_ntz")
    s = history.sessions(c)
    assert values(s, "author", "commits", "minutes") == [("a", 1, 30.0), ("a", 2, 149.0), ("b", 1, 30.0)]
    assert values(history.cap_days(s, 90), "author", "minutes") == [("a", 30 * 90 / 179), ("a", 149 * 90 / 179), ("b", 30.0)]
    assert values(history.over_time(s, "week"), "bucket", "author") == [("2024-01-01", "a"), ("2024-01-01", "b")]
    assert values(history.best_weekday(s), "author", "best_dow") == [("a", 0), ("b", 0)]
    days = spark.createDataFrame([("a", dt.datetime(2024, 1, 31)), ("a", dt.datetime(2024, 2, 1)), ("a", dt.datetime(2024, 2, 3))], "author string, ts timestamp_ntz")
    assert values(history.streaks(days), "author", "active_days", "streak") == [("a", 3, 2)]


def test_patches_and_ranges(spark):
    patch = "@@ -1,2 +1,2 @@\n a\n-b\n+c\n\\ No newline at end of file\n@@ -9 +9 @@\n+z"
    d = spark.createDataFrame([("f", patch), ("g", "Binary files differ"), ("h", None)], "key string, patch string")
    got = [tuple(r) for r in history.parse_patches(d).orderBy("hunk", "text").collect()]
    assert got == [("f", 0, "context", 1, 1, "a"), ("f", 0, "del", 2, None, "b"), ("f", 0, "add", None, 2, "c"), ("f", 1, "add", None, 9, "z")]
    r = spark.createDataFrame([("f", 1, 100, "x"), ("f", 101, 101, None)], "file string, start_line int, end_line int, author string")
    p = spark.createDataFrame([("f", 64), ("f", 101), ("f", 200)], "file string, line_no int")
    assert values(history.ranges_at(p, r, ["file"]), "line_no", "start_line") == [(64, 1), (101, 101)]
    assert values(history.ownership(r), "author", "lines", "pct") == [("Unknown", 1, 1.0), ("x", 100, 99.0)]


def test_compare(spark):
    i = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 2), ("b", 3), ("c", 9)], "repo string, item int")
    assert values(compare.shared_counts(i), "a", "b", "shared", "size_a", "size_b") == [("a", "b", 1, 2, 2)]
    d = spark.createDataFrame([("a", "p", "1", False), ("a", "p", "2", True), ("b", "p", "1", False), ("b", "q", "1", False)], "repo string, pkg string, version string, is_dev boolean")
    assert [(r.pkg, r.kind, r.versions) for r in compare.shared_and_unique(d).orderBy("pkg").collect()] == [("p", "shared", {"a": "2", "b": "1"}), ("q", "unique", {"b": "1"})]


def test_reports(spark):
    e = spark.createDataFrame([("a/x", "b", 2), ("b", "c", 5)], "src string, dst string, n int")
    assert report.mermaid(e).first().text == "flowchart LR\n  b -->|5| c\n  a_x -->|2| b"


def test_archives_and_manifests(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        for name, text in (("top/a.py", "x"), ("top/b.bin", "y"), ("top/../c.py", "z"), ("top/d/e.ts", "w")):
            z.writestr(name, text)
    assert values(repo.read_archives(spark, str(tmp_path / "r.zip")), "path", "content") == [("a.py", "x"), ("d/e.ts", "w")]
    m = spark.createDataFrame([("r", '{"dependencies": {"a": "^1.0"}, "devDependencies": {"b": "~2"}}'), ("s", "{")], "repo string, content string")
    assert values(repo.manifest_deps(m), "pkg", "version", "is_dev") == [("a", "1.0", False), ("b", "2", True)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f.txt").write_text("hi\nyou")
    assert [r.content for r in repo.read_files(spark, str(tmp_path / "x")).collect()] == ["hi\nyou"]



def test_streams(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = lambda: streams.event_stream(spark, "/root/testdata/sf0.001", batch.schema, "events.parquet")
    got = streams.drained(streams.windowed(stream(), "1 hour"), "tumbling_test", str(tmp_path / "a"), "complete")
    assert got.agg(F.sum("n")).first()[0] == batch.count()
    once = streams.drained(streams.distinct_events(stream()), "distinct_test", str(tmp_path / "b"))
    assert once.count() == batch.select("event_id").distinct().count()
    limited = streams.drained(streams.rate_limited_stream(stream(), "user_id", 2, 3600), "rate_test", str(tmp_path / "c"), "update")
    want = streams.rate_limited(batch, "user_id", 2, 3600).where("allowed").count()
    assert limited.agg(F.sum("allowed")).first()[0] == want


def test_rate_limit_carries_windows(spark):
    """Windows go on over batches; no task holds all events of a key."""
    t = dt.datetime(2024, 1, 1)
    rows = [("hot", t + dt.timedelta(seconds=(k * 7) % 1000)) for k in range(1000)] + [(None, t), (None, t), (None, t + dt.timedelta(seconds=90))]
    events = spark.createDataFrame(rows, "who string, ts timestamp")
    limited = streams.rate_limited(events, "who", 5, 60)
    plan = limited._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r.key or "", r.us, r.allowed) for r in limited.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    first = min(us for key, us, _ in got if key)
    assert [(key, us) for key, us, ok in got if key and ok] == [("hot", first + 1_000_000 * (60 * w + j)) for w in range(17) for j in range(5)]
    assert [ok for key, _, ok in got if not key] == [True] * 3 and len(got) == 1003
