"""Queries over the standard tables: each applies operators of this package, with the same in SQL beside it.

`documents` stand for files, their lines for lines of code, `events` for commits, `pages` and suppliers' parts for dependency edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.fuzzy import fuzzy_column
from lodestone.functions.text import likely_secret, line_count, parent_path, redact
from lodestone.operators import compare, graph, history, report, scan, search
from lodestone.plans.rules import COMPLIANCE, RULES
from lodestone.sources.tables import table
from lodestone.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LINES = "lines AS (SELECT doc_id AS path, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


# Search ------------------------------------------------------------------------------------------------------------


def _hits(pattern: str, options: str = "") -> str:
    return f"WITH {LINES} SELECT path, line_no::INT AS line_no, len(regexp_extract_all(text, '{pattern}', 0{options}))::BIGINT AS n FROM lines WHERE regexp_matches(text, '{pattern}'{options})"


@query(_hits("(?i)license"))
def search_literal(spark, sf):
    return search.search(docs(spark, sf), "license", "doc_id", "text").select("path", "line_no", "n")


@query(_hits("the"))
def search_case(spark, sf):
    return search.search(docs(spark, sf), "the", "doc_id", "text", case_sensitive=True).select("path", "line_no", "n")


@query(_hits(r"(?i)\bthe\b"))
def search_whole_word(spark, sf):
    return search.search(docs(spark, sf), "the", "doc_id", "text", whole_word=True).select("path", "line_no", "n")


@query(_hits("(?i)[a-z]+ing [a-z]+tion"))
def search_regex(spark, sf):
    return search.search(docs(spark, sf), "[a-z]+ing [a-z]+tion", "doc_id", "text", regex=True).select("path", "line_no", "n")


@query(f"WITH {LINES}, h AS (SELECT path, len(regexp_extract_all(text, '(?i)tion'))::BIGINT AS n FROM lines WHERE regexp_matches(text, '(?i)tion')) SELECT path, count(*) AS n_lines, sum(n)::BIGINT AS n FROM h GROUP BY path ORDER BY n DESC, path LIMIT 50")
def search_rank_topk(spark, sf):
    return search.rank_files(search.search(docs(spark, sf), "tion", "doc_id", "text"))


@query(f"WITH {LINES}, h AS (SELECT path, line_no FROM lines WHERE regexp_matches(text, '(?i)license')) SELECT l.path, h.line_no::INT AS hit_line, l.line_no::INT AS line_no, l.text FROM lines l JOIN h ON l.path = h.path AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2")
def line_context(spark, sf):
    return search.line_context(docs(spark, sf), "license", 2, 2, "doc_id", "text")


@query("SELECT count(DISTINCT doc_id) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents")
def file_index_totals(spark, sf):
    return search.index_totals(docs(spark, sf), "doc_id", "text")


_STEP = "CASE WHEN {0} THEN 10 ELSE 1 END + CASE WHEN {1} = 1 OR substr(p_name, {1} - 1, 1) IN ('/', '.', '-', '_') THEN 5 ELSE 0 END + (substr(p_name, {1}, 1) = '{2}')::INT"


@query(
    "WITH a AS (SELECT p_partkey, p_name, lower(p_name) AS l, strpos(lower(p_name), 'p') AS i FROM part), b AS (SELECT *, CASE WHEN i > 0 AND strpos(substr(l, i + 1), 't') > 0 THEN i + strpos(substr(l, i + 1), 't') END AS j FROM a) "
    f"SELECT p_partkey, p_name, ({_STEP.format('i = 1', 'i', 'p')} + {_STEP.format('j = i + 1', 'j', 't')} - length(p_name) // 20)::INT AS score FROM b WHERE j IS NOT NULL ORDER BY score DESC, p_partkey LIMIT 200"
)
def fuzzy_topk(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", fuzzy_column("pt", F.col("p_name")).alias("score"))
    return parts.where("score is not null").orderBy(F.desc("score"), "p_partkey").limit(200)


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)((?:password|passwd|secret|token|api_key|apikey)\s*[:=]\s*)[\"''][^\"''\n]{4,}[\"'']', '\1" + '"[REDACTED]"' + r"', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\b(?:AKIA|ASIA)[0-9A-Z]{16}\b', '[AWS_KEY]', 'g'), '\b[0-9a-f]{32,}\b', '[HEX]', 'g') AS text FROM documents")
def redact_secrets(spark, sf):
    return docs(spark, sf).select("doc_id", redact(F.col("text")).alias("text"))


@query(
    r"""WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, '"([^"\n]{4,64})"', 1)) AS value FROM documents),
c AS (SELECT DISTINCT value, unnest(string_split(value, '')) AS ch, generate_subscripts(string_split(value, ''), 1) AS i FROM (SELECT DISTINCT value FROM v)),
e AS (SELECT value, -sum(n / t * log2(n / t)) AS bits FROM (SELECT value, ch, count(*)::DOUBLE AS n, length(value)::DOUBLE AS t FROM c GROUP BY value, ch) GROUP BY value)
SELECT doc_id, value, (length(value) >= 8 AND bits >= 3.3) AS real FROM v JOIN e USING (value)"""
)
def entropy_secret_gate(spark, sf):
    v = docs(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('"([^"\\n]{4,64})"'), 1)).alias("value"))
    return v.select("doc_id", "value", likely_secret(F.col("value")).alias("real"))


# Scanner -----------------------------------------------------------------------------------------------------------

_ARMS = " UNION ALL ".join(
    f"SELECT path, line_no, source, '{r.id}' AS rule_id, '{r.severity}' AS severity, '{r.category}' AS category, '{r.confidence}' AS confidence, '{r.cwe}' AS cwe FROM lines WHERE regexp_matches(text, '{r.pattern}')"
    + (f" AND NOT regexp_matches(text, '{r.exclude}')" if r.exclude else "")
    for r in RULES
)
ISSUES = f"{LINES}, issues AS ({_ARMS})"
_SCORE = "floor(greatest(least(CASE severity WHEN 'critical' THEN 9.0::DOUBLE WHEN 'warning' THEN 5.0::DOUBLE ELSE 2.0::DOUBLE END * CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END + CASE category WHEN 'security' THEN 1.0::DOUBLE WHEN 'reliability' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN cwe <> '' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 10.0), 0.0) * 10 + 0.5)::BIGINT"


def issues(spark, sf) -> DataFrame:
    return scan.scan_lines(docs(spark, sf), RULES, "doc_id", "text")


@query(f"WITH {ISSUES} SELECT path, line_no::INT AS line_no, rule_id, severity, confidence FROM issues")
def rules_line_scan(spark, sf):
    return issues(spark, sf).select("path", "line_no", "rule_id", "severity", "confidence")


@query(f"WITH {ISSUES} SELECT path, line_no::INT AS line_no, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY path, line_no) AS rn FROM issues) WHERE rn <= {scan.CAP}")
def rule_cap(spark, sf):
    return scan.cap_rules(issues(spark, sf))[0].select("path", "line_no", "rule_id")


@query(f"WITH {ISSUES} SELECT rule_id, count(*) - {scan.CAP} AS overflow FROM issues GROUP BY rule_id HAVING count(*) > {scan.CAP}")
def rule_cap_overflow(spark, sf):
    return scan.cap_rules(issues(spark, sf))[1]


@query(f"WITH {ISSUES} SELECT rule_id, {_SCORE} AS tenths, count(*) AS n FROM issues GROUP BY ALL")
def risk_score(spark, sf):
    return scan.score(issues(spark, sf)).groupBy("rule_id", F.round(F.col("risk_score") * 10).cast("long").alias("tenths")).agg(F.count("*").alias("n"))


@query(f"WITH {ISSUES} SELECT CASE WHEN t >= 80 THEN 'critical' WHEN t >= 50 THEN 'high' WHEN t >= 30 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM (SELECT {_SCORE} AS t FROM issues) GROUP BY 1")
def risk_distribution(spark, sf):
    return scan.score(issues(spark, sf)).groupBy(scan.band(F.col("risk_score")).alias("band")).agg(F.count("*").alias("n"))


_SUMMARY = "count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in scan.SEVERITIES) + ", " + ", ".join(f"count(*) FILTER (WHERE category = '{s}') AS {s}" for s in ("security", "reliability", "style")) + ", count(*) FILTER (WHERE severity = 'warning' AND category = 'security') AS security_warnings"


@query(f"WITH {ISSUES} SELECT rule_id, {_SUMMARY} FROM issues GROUP BY rule_id")
def scan_summary(spark, sf):
    return scan.summary(issues(spark, sf), ["rule_id"])


@query(
    f"""WITH {ISSUES}, s AS (SELECT source, {_SUMMARY} FROM issues GROUP BY source), k AS (SELECT source, count(*) AS sloc FROM lines GROUP BY source),
p AS (SELECT source, total, sloc, least(CASE WHEN critical > 0 THEN 35 ELSE 100 END, CASE WHEN security_warnings > 0 THEN 89 ELSE 100 END, greatest(0, least(100, 100 - 30 * critical - 8 * warning - 2 * info))) AS points, floor(total * 1000000 / greatest(sloc, 1))::BIGINT AS m FROM s JOIN k USING (source))
SELECT source, points::BIGINT AS points, CASE WHEN points >= 90 THEN 'A' WHEN points >= 75 THEN 'B' WHEN points >= 60 THEN 'C' WHEN points >= 40 THEN 'D' ELSE 'F' END AS grade, m AS issues_per_kloc_milli, CASE WHEN m < 5000 THEN 'A' WHEN m < 15000 THEN 'B' WHEN m < 30000 THEN 'C' WHEN m < 50000 THEN 'D' ELSE 'F' END AS quality FROM p"""
)
def health_grades(spark, sf):
    d = docs(spark, sf)
    found = scan.scan_lines(d, RULES, "doc_id", "text", ("source",))
    sloc = d.groupBy("source").agg(F.sum(line_count(F.col("text"))).alias("sloc"))
    return scan.grades(scan.summary(found, ["source"]).join(sloc, "source"), F.col("sloc")).select("source", "points", "grade", "issues_per_kloc_milli", "quality")


@query(f"WITH {ISSUES}, f AS (SELECT path, line_no, max(regexp_matches(text, '[|]')::INT) OVER w1 AS a, max(regexp_matches(text, '[|]')::INT) OVER w2 AS b FROM lines WINDOW w1 AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) SELECT path, line_no::INT AS line_no FROM f WHERE greatest(coalesce(a, 0), coalesce(b, 0)) = 1")
def sanitizer_window(spark, sf):
    return scan.near_line(docs(spark, sf), lambda t: t.rlike("[|]"), 3, 3, "doc_id", "text").where("near").select("path", "line_no")


@query(f"WITH {LINES}, f AS (SELECT path, line_no, text, lag(text) OVER (PARTITION BY path ORDER BY line_no) AS before FROM lines) SELECT path, line_no::INT AS line_no FROM f WHERE contains(text, 'All rights') OR coalesce(contains(before, 'tion.'), false)")
def suppression_context(spark, sf):
    return scan.suppressed(docs(spark, sf), "All rights", "tion.", "doc_id", "text").where("hidden").select("path", "line_no")


@query(f"WITH {LINES}, g AS (SELECT path, min(CASE WHEN regexp_matches(text, '[Ll]icense') THEN line_no END) AS license, min(CASE WHEN regexp_matches(text, 'tion') THEN line_no END) AS word, bool_or(regexp_matches(text, '[#]{{3}}')) AS bad FROM lines GROUP BY path) SELECT path, license::INT AS license, word::INT AS word FROM g WHERE NOT bad AND license IS NOT NULL AND word IS NOT NULL AND abs(license - word) <= 10")
def composite_cooccurrence(spark, sf):
    return scan.together(search.to_lines(docs(spark, sf), "doc_id", "text"), {"license": "[Ll]icense", "word": "tion"}, "[#]{3}", 10)


@query(f"WITH {ISSUES} SELECT path, line_no::INT AS line_no, rule_id FROM issues WHERE rule_id IN ('email-address', 'long-number', 'license-line')")
def merge_scans(spark, sf):
    i = issues(spark, sf).select("path", "line_no", "rule_id")
    return scan.merge(i.where("rule_id in ('email-address', 'long-number')"), i.where("rule_id in ('long-number', 'license-line')"), ["path", "line_no", "rule_id"])


_ITEMS = ", ".join(f"('{a}', '{b}')" for a, b in COMPLIANCE)
_RULES = ", ".join(f"('{r.id}', '{r.cwe}')" for r in RULES)


@query(
    f"""WITH {ISSUES}, items(item, cwe) AS (VALUES {_ITEMS}), rules(rule_id, cwe) AS (VALUES {_RULES}), n AS (SELECT cwe, count(*) AS n FROM issues GROUP BY cwe),
c AS (SELECT item, count(DISTINCT rule_id) AS n_rules FROM items LEFT JOIN rules USING (cwe) GROUP BY item), k AS (SELECT item, coalesce(sum(n), 0)::BIGINT AS n_issues FROM items LEFT JOIN n USING (cwe) GROUP BY item)
SELECT item, n_rules, n_issues, CASE WHEN n_rules = 0 THEN 'no-coverage' WHEN n_issues > 0 THEN 'fail' WHEN n_rules <= 1 THEN 'warn' ELSE 'pass' END AS status FROM c JOIN k USING (item)"""
)
def compliance_coverage(spark, sf):
    items = spark.createDataFrame(COMPLIANCE, "item string, cwe string")
    rules = spark.createDataFrame([(r.id, r.cwe) for r in RULES], "rule_id string, cwe string")
    return scan.coverage(items, rules, issues(spark, sf))


@query(f"WITH {ISSUES}, a AS (SELECT DISTINCT path AS doc_id FROM issues WHERE rule_id = 'symbol-noise'), e AS (SELECT doc_id FROM labels WHERE quality = 0) SELECT 'symbol-noise' AS rule_id, count(*) FILTER (WHERE a.doc_id IS NOT NULL AND e.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE e.doc_id IS NULL) AS fp, count(*) FILTER (WHERE a.doc_id IS NULL) AS missed FROM a FULL JOIN e USING (doc_id)")
def accuracy_metrics(spark, sf):
    one = lambda d: d.select(F.lit("symbol-noise").alias("rule_id"), "doc_id")
    actual = issues(spark, sf).where("rule_id = 'symbol-noise'").select(F.col("path").alias("doc_id")).distinct()
    return scan.accuracy(one(table(spark, sf, "labels").where("quality = 0")), one(actual), ["doc_id"])


# Reports -----------------------------------------------------------------------------------------------------------


def _breakdown(key: str) -> str:
    return f"WITH g AS (SELECT {key} AS key, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY 1) SELECT key, files, lines, floor(lines * 10000 / sum(lines) OVER ())::BIGINT AS bp FROM g"


@query(_breakdown("lang"))
def lang_breakdown(spark, sf):
    return report.breakdown(docs(spark, sf), F.col("lang"), "text")


@query(_breakdown("source"))
def folder_breakdown(spark, sf):
    return report.breakdown(docs(spark, sf), F.col("source"), "text")


PAGE_PATH = "regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '')"


@query(
    f"""WITH p AS (SELECT string_split({PAGE_PATH}, '/') AS s, length(html) AS size FROM pages), e AS (SELECT s, size, unnest(range(1, len(s) + 1)) AS k FROM p)
SELECT array_to_string(s[1:k], '/') AS prefix, k::INT AS depth, sum(size)::BIGINT AS size FROM e GROUP BY 1, 2 HAVING sum(size) > 0"""
)
def treemap_rollup(spark, sf):
    p = table(spark, sf, "pages").select(F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/+$", "").alias("path"), F.length("html").cast("long").alias("size"))
    return report.treemap(p)


@query("WITH g AS (SELECT p_brand AS key, count(*) AS n FROM part GROUP BY 1), t AS (SELECT * FROM g ORDER BY n DESC, key LIMIT 10) SELECT * FROM t UNION ALL SELECT '+' || count(*) || ' more', sum(n)::BIGINT FROM g WHERE key NOT IN (SELECT key FROM t) HAVING count(*) > 0")
def top_with_rest(spark, sf):
    return report.top_with_rest(table(spark, sf, "part").groupBy(F.col("p_brand").alias("key")).agg(F.count("*").alias("n")), "key", "n", 10)


@query("SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def region_rollup(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('week', ts)::DATE::VARCHAR AS week, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in ("view", "signup", "purchase", "click", "error")) + " FROM events GROUP BY 1")
def pivot_week_type(spark, sf):
    kinds = ["view", "signup", "purchase", "click", "error"]
    e = table(spark, sf, "events").groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")).pivot("event_type", kinds).count()
    return e.na.fill(0, kinds)


@query("SELECT conv_id, turn, role, CASE WHEN rn > 4 THEN substr(text, 1, 80) ELSE text END AS text, rn > 4 AS compacted FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)")
def conversation_compaction(spark, sf):
    return report.keep_recent(table(spark, sf, "conversations"), "conv_id", "turn", "text", 4, 80)


# Graph: suppliers are files, the parts they deliver are what they import ----------------------------------------------

EDGES = "edges AS (SELECT DISTINCT url AS src, 'host:' || regexp_extract(url, '://([^/?#]*)', 1) AS dst FROM pages UNION SELECT DISTINCT 'host:' || regexp_extract(url, '://([^/?#]*)', 1), 'tld:' || regexp_extract(url, '://[^/?#]*[.]([a-z]+)', 1) FROM pages)"
DEG = "deg AS (SELECT node, sum(i)::BIGINT AS in_deg, sum(o)::BIGINT AS out_deg FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node)"


def page_edges(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages")
    host = F.concat(F.lit("host:"), F.regexp_extract("url", "://([^/?#]*)", 1))
    tld = F.concat(F.lit("tld:"), F.regexp_extract("url", "://[^/?#]*[.]([a-z]+)", 1))
    return p.select(F.col("url").alias("src"), host.alias("dst")).unionAll(p.select(host, tld)).distinct()


@query(f"WITH {EDGES}, {DEG} SELECT * FROM deg")
def graph_degrees(spark, sf):
    return graph.degrees(page_edges(spark, sf))


@query(
    f"""WITH {EDGES}, {DEG}, e AS (SELECT node FROM deg WHERE in_deg = 0 AND out_deg > 0 ORDER BY out_deg DESC, node LIMIT 20), k AS (SELECT greatest(2, ceil(count(*) / 10.0))::INT AS k FROM deg),
h AS (SELECT node FROM (SELECT node, row_number() OVER (ORDER BY in_deg DESC, node) AS rn FROM deg WHERE in_deg >= 2), k WHERE rn <= k)
SELECT node, in_deg, out_deg, node IN (SELECT node FROM e) AS is_entry, node IN (SELECT node FROM h) AS is_hub, in_deg = 0 AND out_deg = 0 AS is_orphan, out_deg = 0 AND in_deg > 0 AS is_leaf FROM deg"""
)
def graph_roles(spark, sf):
    e = page_edges(spark, sf)
    return graph.roles(e.select(F.col("src").alias("node")).unionAll(e.select("dst")), e)


@query(f"WITH {EDGES} SELECT n.node FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n WHERE NOT EXISTS (SELECT 1 FROM edges WHERE dst = n.node)")
def graph_unreferenced(spark, sf):
    e = page_edges(spark, sf)
    return graph.unreferenced(e.select(F.col("src").alias("node")).unionAll(e.select("dst")).distinct(), e)


@query("SELECT 'c' || c_custkey AS node, min('c' || c_custkey) OVER (PARTITION BY c_nationkey) AS component FROM customer UNION ALL SELECT 'n' || n_nationkey, (SELECT min('c' || c_custkey) FROM customer WHERE c_nationkey = n_nationkey) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def graph_components(spark, sf):
    e = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    return graph.components(spark, e)


@query(
    f"""WITH RECURSIVE {EDGES}, s AS (SELECT DISTINCT src AS node FROM edges WHERE src NOT LIKE 'host:%'), w AS (SELECT node AS entry, node, 0 AS depth FROM s UNION SELECT w.entry, e.dst, w.depth + 1 FROM w JOIN edges e ON e.src = w.node WHERE w.depth < 5)
SELECT node, max(d)::BIGINT AS depth FROM (SELECT entry, node, min(depth) AS d FROM w GROUP BY ALL) WHERE d > 0 GROUP BY node"""
)
def graph_depth(spark, sf):
    e = page_edges(spark, sf)
    return graph.depths(spark, e, e.where("src not like 'host:%'").select(F.col("src").alias("node")).distinct())


@query(f"WITH {EDGES}, s AS (SELECT min(dst) AS node FROM edges WHERE dst LIKE 'host:%'), n AS (SELECT node FROM s UNION SELECT src FROM edges JOIN s ON dst = node UNION SELECT dst FROM edges JOIN s ON src = node) SELECT src, dst FROM edges WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def graph_neighbourhood(spark, sf):
    e = page_edges(spark, sf)
    return graph.neighbourhood(e, e.where("dst like 'host:%'").agg(F.min("dst").alias("node")), 1)


@query("SELECT regexp_extract(url, '://[^/?#]*[.]([a-z]+)', 1) AS dst, regexp_extract(url, '://([^/?#]*)', 1) AS src, count(*) AS n FROM pages GROUP BY ALL")
def dir_edge_rollup(spark, sf):
    e = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("src"), F.regexp_extract("url", "://[^/?#]*[.]([a-z]+)", 1).alias("dst"))
    return graph.rollup_edges(e, F.split("src", "/")[0], F.col("dst"))


@query("SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS a FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_suppkey AND b.l_orderkey = a.l_suppkey AND a.l_suppkey < a.l_orderkey")
def graph_two_cycles(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_orderkey").alias("dst"))
    return graph.two_cycles(li).select("a").distinct()


# History: events are commits -----------------------------------------------------------------------------------------

SESSIONS = """c AS (SELECT user_id AS author, ts FROM events WHERE event_type <> 'error'),
m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 7200000000 THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY author ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY author ORDER BY ts) AS s FROM m),
ses AS (SELECT author, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS commits, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0::DOUBLE + 30 AS minutes FROM g GROUP BY author, s)"""


def commits(spark, sf) -> DataFrame:
    return table(spark, sf, "events").where("event_type <> 'error'").select(F.col("user_id").alias("author"), "ts")


@query(f"WITH {SESSIONS} SELECT author, start_ts, end_ts, commits, round(minutes * 1000)::BIGINT AS milli FROM ses")
def coding_sessions(spark, sf):
    return history.sessions(commits(spark, sf)).select("author", "start_ts", "end_ts", "commits", F.round(F.col("minutes") * 1000).cast("long").alias("milli"))


@query(f"WITH {SESSIONS}, d AS (SELECT *, sum(minutes) OVER (PARTITION BY author, start_ts::DATE) AS day FROM ses) SELECT author, start_ts, round(CASE WHEN day > 90 THEN minutes * 90 / day ELSE minutes END * 100)::BIGINT AS centi FROM d")
def session_hours_capped(spark, sf):
    return history.cap_days(history.sessions(commits(spark, sf)), 90).select("author", "start_ts", F.round(F.col("minutes") * 100).cast("long").alias("centi"))


@query("WITH d AS (SELECT DISTINCT user_id AS author, ts::DATE AS day FROM events WHERE event_type <> 'error'), i AS (SELECT author, day - row_number() OVER (PARTITION BY author ORDER BY day)::INT AS k FROM d), r AS (SELECT author, k, count(*) AS n FROM i GROUP BY ALL) SELECT author, sum(n)::BIGINT AS active_days, max(n) AS streak FROM r GROUP BY author")
def commit_streaks(spark, sf):
    return history.streaks(commits(spark, sf))


@query(f"WITH {SESSIONS} SELECT dayofweek(start_ts)::INT AS dow, hour(start_ts)::INT AS hour, count(*) AS sessions FROM ses GROUP BY ALL")
def punch_card(spark, sf):
    return history.punch_card(history.sessions(commits(spark, sf))).drop("minutes")


def _bucket(unit: str) -> str:
    form = "%Y-%m" if unit == "month" else "%Y-%m-%d"
    return f"WITH {SESSIONS} SELECT strftime(date_trunc('{unit}', start_ts), '{form}') AS bucket, author, count(*) AS sessions FROM ses GROUP BY ALL"


@query(_bucket("day"))
def hours_by_day(spark, sf):
    return history.over_time(history.sessions(commits(spark, sf)), "day").drop("minutes")


@query(_bucket("week"))
def hours_by_week(spark, sf):
    return history.over_time(history.sessions(commits(spark, sf)), "week").drop("minutes")


@query(_bucket("month"))
def hours_by_month(spark, sf):
    return history.over_time(history.sessions(commits(spark, sf)), "month").drop("minutes")


@query("SELECT o_custkey AS author, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY ALL")
def group_by_author_date(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("author"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_min(value, ts) FILTER (WHERE event_type = 'purchase' AND value IS NOT NULL) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def first_known_value(spark, sf):
    return history.first_known(table(spark, sf, "events").where("event_type = 'purchase'"), "user_id", "value", "ts")


RANGES = "r AS (SELECT l_orderkey AS file, l_linenumber * 3 AS start_line, l_linenumber * 3 + (l_partkey % 3)::INT AS end_line, l_suppkey AS author FROM lineitem)"


def ranges(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") * 3).alias("start_line"), (F.col("l_linenumber") * 3 + (F.col("l_partkey") % 3).cast("int")).alias("end_line"), F.col("l_suppkey").alias("author"))


@query(f"WITH {RANGES} SELECT file, author, start_line::INT AS start_line, end_line::INT AS end_line, unnest(range(start_line, end_line + 1))::INT AS line_no FROM r")
def blame_expand(spark, sf):
    return history.expand_ranges(ranges(spark, sf)).drop("is_start")


@query(f"WITH {RANGES}, g AS (SELECT author::VARCHAR AS author, sum(end_line - start_line + 1)::BIGINT AS lines FROM r GROUP BY author) SELECT author, lines, floor(lines * 100.0::DOUBLE / sum(lines) OVER () * 10 + 0.5) / 10 AS pct FROM g")
def blame_ownership(spark, sf):
    return history.ownership(ranges(spark, sf).withColumn("author", F.col("author").cast("string")))


@query(f"WITH {RANGES}, p AS (SELECT o_orderkey AS file, (o_custkey % 20)::INT AS line_no FROM orders) SELECT file, line_no, author FROM p JOIN r USING (file) WHERE line_no BETWEEN start_line AND end_line")
def blame_range_join(spark, sf):
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 20).cast("int").alias("line_no"))
    return history.ranges_at(points, ranges(spark, sf), ["file"], 8).select("file", "line_no", "author")


# Comparison ----------------------------------------------------------------------------------------------------------

ITEMS = "items AS (SELECT DISTINCT source AS repo, md5(unnest(string_split(text, chr(10)))) AS item FROM documents), z AS (SELECT repo, count(*) AS size FROM items GROUP BY repo), s AS (SELECT a.repo AS a, b.repo AS b, count(*) AS shared FROM items a JOIN items b ON a.item = b.item AND a.repo < b.repo GROUP BY ALL)"


def line_items(spark, sf) -> DataFrame:
    return docs(spark, sf).select(F.col("source").alias("repo"), F.explode(F.split("text", "\n", -1)).alias("line")).select("repo", F.md5("line").alias("item"))


@query(f"WITH {ITEMS} SELECT a, b, shared, (shared * 1000000 // (x.size + y.size - shared))::BIGINT AS jaccard_ppm, (shared * 1000000 // least(x.size, y.size))::BIGINT AS containment_ppm FROM s JOIN z x ON x.repo = a JOIN z y ON y.repo = b")
def set_similarity(spark, sf):
    ppm = lambda c: F.floor(c * 1_000_000 + 1e-6).cast("long")
    a, b = F.col("size_a"), F.col("size_b")
    return compare.shared_counts(line_items(spark, sf)).select("a", "b", "shared", ppm(compare.jaccard(F.col("shared"), a, b)).alias("jaccard_ppm"), ppm(compare.containment(F.col("shared"), a, b)).alias("containment_ppm"))


@query("WITH w AS (SELECT source AS repo, lang AS item, count(*)::DOUBLE AS w FROM documents GROUP BY ALL), n AS (SELECT repo, sqrt(sum(w * w)) AS n FROM w GROUP BY repo) SELECT x.repo AS a, y.repo AS b, round(sum(x.w * y.w) / any_value(p.n * q.n) * 1000000)::BIGINT AS cosine_ppm FROM w x JOIN w y ON x.item = y.item AND x.repo < y.repo JOIN n p ON p.repo = x.repo JOIN n q ON q.repo = y.repo GROUP BY ALL")
def cosine_languages(spark, sf):
    w = docs(spark, sf).groupBy(F.col("source").alias("repo"), F.col("lang").alias("item")).agg(F.count("*").alias("w"))
    return compare.cosine(w).select("a", "b", F.round(F.col("cosine") * 1_000_000).cast("long").alias("cosine_ppm"))


@query("SELECT DISTINCT md5(text) AS sha FROM documents WHERE source = 'src14' AND md5(text) IN (SELECT md5(text) FROM documents WHERE source = 'src2')")
def identical_docs(spark, sf):
    f = docs(spark, sf).select(F.col("source").alias("repo"), F.col("doc_id").alias("path"), F.md5("text").alias("sha"))
    return compare.identical(f, "src14", "src2").select("sha")


@query("WITH d AS (SELECT DISTINCT l_suppkey AS repo, l_partkey AS pkg FROM lineitem) SELECT pkg, count(*) AS n_repos, CASE WHEN count(*) >= 2 THEN 'shared' ELSE 'unique' END AS kind FROM d GROUP BY pkg")
def dep_shared_unique(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("repo"), F.col("l_partkey").alias("pkg"), F.col("l_linenumber").cast("string").alias("version"), F.lit(False).alias("is_dev"))
    return compare.shared_and_unique(d).drop("versions")


# Events ---------------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    return streams.windowed(table(spark, sf, "events"), "15 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def sliding_windows(spark, sf):
    return streams.windowed(table(spark, sf, "events"), "60 minutes", "30 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS last_end, count(*) AS n FROM g GROUP BY user_id, s"""
)
def session_windows(spark, sf):
    found = streams.session_windows(table(spark, sf, "events"), "user_id", "30 minutes")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last_end").cast("timestamp_ntz").alias("last_end"), "n")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def distinct_events(spark, sf):
    return streams.distinct_events(table(spark, sf, "events")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS k, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
w AS (SELECT k, rn, ts AS start, 1 AS n FROM e WHERE rn = 1 UNION ALL SELECT e.k, e.rn, CASE WHEN e.ts >= w.start + INTERVAL 3600 SECOND THEN e.ts ELSE w.start END, CASE WHEN e.ts >= w.start + INTERVAL 3600 SECOND THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.k = w.k AND e.rn = w.rn + 1)
SELECT k::VARCHAR AS key, count(*) FILTER (WHERE n <= 2) AS allowed, count(*) AS n FROM w GROUP BY k"""
)
def rate_limit(spark, sf):
    return streams.rate_limited(table(spark, sf, "events"), "user_id", 2, 3600).groupBy("key").agg(F.count(F.when(F.col("allowed"), 1)).alias("allowed"), F.count("*").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.ref') AS ref, props IS NOT NULL AS has_props FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.ref").alias("ref"), F.col("props").isNotNull().alias("has_props"))


@query(f"SELECT DISTINCT CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS parent FROM (SELECT {PAGE_PATH} AS p FROM pages)")
def folder_list(spark, sf):
    return table(spark, sf, "pages").select(F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/+$", "").alias("p")).select(parent_path(F.col("p")).alias("parent")).distinct()


@query("SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href=\"(/[^\"<>]*)\"', 1)) AS dst FROM pages")
def link_edges(spark, sf):
    return table(spark, sf, "pages").select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"<>]*)"'), 1)).alias("dst")).distinct()
