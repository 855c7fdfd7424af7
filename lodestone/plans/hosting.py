"""Queries over answers of a hosting service, manifests and settings that Spark renders from the given tables, each with SQL that takes the same from the tables' columns.

A supplier is a repository, its nation the owner; an order is a commit, a pull request or a comparison, its lines are files; a part is a package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import glob_filter, node_id, normalize_path, register, repository, resolve_path, share_link, short_path, strip_version, top_folder
from lodestone.operators import compare, context, fixes, graph, history, parse, report, search, structure, supply, tools
from lodestone.plans.code import _FILES, _MORE, _PARTS, _sql, code_files, document_files, several_languages, typescript
from lodestone.plans.queries import query
from lodestone.sources import dumps, repo
from lodestone.sources.tables import table


def text(*parts: str | Column) -> Column:
    """A text of literals and columns' values (names begin with a lower-case letter and have an underscore)."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") if "_" in p and p.isidentifier() else F.lit(p) for p in parts))


def answer(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


# Answers -------------------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey AS id, 'n' || s_nationkey || '/s' || s_suppkey AS full_name, 'n' || s_nationkey AS owner, 's' || s_suppkey AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'trunk' ELSE 'main' END AS default_branch, CASE WHEN s_suppkey % 3 > 0 THEN 'Go' END AS language FROM supplier")
def repository_dump(spark, sf):
    s = table(spark, sf, "supplier")
    content = answer(id=F.col("s_suppkey"), full_name=text("n", "s_nationkey", "/s", "s_suppkey"), default_branch=F.when(F.col("s_suppkey") % 4 == 0, "trunk"), language=F.when(F.col("s_suppkey") % 3 > 0, "Go"))
    broken = s.limit(1).select(F.lit("{").alias("content"))
    return dumps.repositories(s.select(content.alias("content")).unionByName(broken)).select("id", "full_name", "owner", "name", "default_branch", "language")


def _files_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "lineitem")
    one = F.struct(text("src/p", "l_partkey", ".ts").alias("filename"), F.col("l_returnflag").alias("status"), F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"))
    return i.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("files"))  # an order has some lines


@query("SELECT l_orderkey AS pull, 'diverged' AS status, 'src/p' || l_partkey || '.ts' AS path, l_returnflag AS change, l_quantity::BIGINT AS additions, l_linenumber::BIGINT AS deletions FROM lineitem")
def comparison_dump(spark, sf):
    answers = _files_of_orders(spark, sf).select(F.col("l_orderkey").alias("pull"), answer(status=F.lit("diverged"), ahead_by=F.lit(1), files=F.col("files")).alias("content"))
    return dumps.comparisons(answers, ["pull"]).select("pull", "status", "path", "change", "additions", "deletions")


@query("SELECT l_orderkey AS pull, count(*) AS files, sum(l_quantity)::BIGINT AS additions, sum(l_linenumber)::BIGINT AS deletions FROM lineitem GROUP BY l_orderkey")
def change_stats(spark, sf):
    answers = _files_of_orders(spark, sf).select(F.col("l_orderkey").alias("pull"), answer(status=F.lit("ahead"), files=F.col("files")).alias("content"))
    return dumps.change_stats(dumps.comparisons(answers, ["pull"]), ["pull"])


@query("SELECT l_orderkey AS id, 't' || l_orderkey AS tree_sha, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_quantity) - 1)::INT AS ordinal, 'p' || l_partkey AS path, CASE WHEN l_partkey % 5 = 0 THEN 'tree' ELSE 'blob' END AS type, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE l_quantity::BIGINT END AS size FROM lineitem")
def tree_dump(spark, sf):
    folder = F.col("l_partkey") % 5 == 0
    entry = F.struct(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("q"), text("p", "l_partkey").alias("path"), F.when(folder, "tree").otherwise("blob").alias("type"), F.when(~folder, F.col("l_quantity").cast("long")).alias("size"))
    trees = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("tree"))
    answers = trees.select(F.col("l_orderkey").alias("id"), answer(sha=text("t", "l_orderkey"), tree=F.col("tree")).alias("content"))
    return dumps.trees(answers, ["id"]).select("id", "tree_sha", "ordinal", "path", "type", "size")


@query("SELECT o_custkey AS repo, 'c' || o_orderkey AS sha, CASE WHEN o_orderkey % 9 = 0 THEN 'Merge pull request #' || o_orderkey ELSE 'order ' || o_orderpriority END AS message, 'cust ' || o_custkey AS author_name, o_orderdate AS author_date, CASE WHEN o_custkey % 3 > 0 THEN 'u' || o_custkey END AS author_login, CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 1 END AS n_parents FROM orders")
def commit_dump(spark, sf):
    return _commits(spark, sf).select("repo", "sha", "message", "author_name", F.col("author_date").cast("timestamp_ntz").alias("author_date"), "author_login", "n_parents")


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    date = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    person = F.struct(F.concat(F.when(F.col("o_orderkey") % 11 == 0, "dependabot[bot] ").otherwise("cust "), F.col("o_custkey").cast("string")).alias("bot"), text("cust ", "o_custkey").alias("name"), date.alias("date"))
    merge = F.col("o_orderkey") % 9 == 0
    parents = F.transform(F.sequence(F.lit(1), F.when(merge, 2).otherwise(1)), lambda k: F.struct(k.cast("string").alias("sha")))
    one = F.struct(text("c", "o_orderkey").alias("sha"), F.struct(F.when(merge, text("Merge pull request #", "o_orderkey")).otherwise(text("order ", "o_orderpriority")).alias("message"), person.alias("author"), person.alias("committer")).alias("commit"), F.when(F.col("o_custkey") % 3 > 0, F.struct(text("u", "o_custkey").alias("login"))).alias("author"), parents.alias("parents"))
    # One answer for a customer's orders of a year: pages of an answer, as services give them.
    answers = o.groupBy(F.col("o_custkey").alias("repo"), F.year("o_orderdate").alias("year")).agg(F.to_json(F.collect_list(one)).alias("content"))
    return dumps.commits(answers, ["repo"])


@query("SELECT o_custkey AS repo, count(*) AS n FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY o_custkey")
def human_commits(spark, sf):
    c = _commits(spark, sf)
    return history.human_commits(c.withColumn("n_parents", F.when(F.col("message").startswith("Merge"), 2).otherwise(1)).withColumn("author", F.col("author_name"))).groupBy("repo").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS number, 'order ' || o_orderkey AS title, CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'open' ELSE 'closed' END AS state, 'u' || o_custkey AS author, 'main' AS base FROM orders")
def pull_dump(spark, sf):
    status = F.col("o_orderstatus")
    content = answer(number=F.col("o_orderkey"), title=text("order ", "o_orderkey"), state=F.when(status == "O", "open").otherwise("closed"), merged=status == "F", user=F.struct(text("u", "o_custkey").alias("login")), base=F.struct(F.lit("main").alias("ref")))
    return dumps.pulls(table(spark, sf, "orders").select(content.alias("content")), []).select("number", "title", "state", "author", "base")


@query("SELECT s_nationkey AS repo, 'branch/' || s_suppkey AS name, md5(s_name) AS sha FROM supplier")
def ref_dump(spark, sf):
    one = F.struct(text("branch/", "s_suppkey").alias("name"), F.struct(F.md5(F.col("s_name").cast("binary")).alias("sha")).alias("commit"))
    return dumps.refs(table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("repo")).agg(F.to_json(F.collect_list(one)).alias("content")), ["repo"])


_BLAME = "b AS (SELECT l_suppkey AS file, (l_orderkey * 10)::INT AS start_line, (l_orderkey * 10 + l_quantity::INT % 10)::INT AS end_line, 'u' || l_partkey % 7 || '@h' AS email FROM lineitem)"


def _blames(spark: SparkSession, sf: str, users: bool = False) -> DataFrame:
    """Blame answers; with `users`, some authors have an account."""
    start = (F.col("l_orderkey") * 10).cast("int")
    author = F.struct(F.concat(F.lit("User "), (F.col("l_partkey") % 7).cast("string")).alias("name"), F.concat(F.lit("u"), (F.col("l_partkey") % 7).cast("string"), F.lit("@h")).alias("email"), F.when(F.lit(users) & (F.col("l_partkey") % 3 > 0), F.struct(F.concat(F.lit("user"), (F.col("l_partkey") % 7).cast("string")).alias("login"))).alias("user"))
    one = F.struct(start.alias("startingLine"), (start + F.col("l_quantity").cast("int") % 10).alias("endingLine"), F.lit(1).alias("age"), F.struct(text("c", "l_orderkey").alias("oid"), author.alias("author")).alias("commit"))
    # An answer for a few orders of a supplier, so that none grows with the table.
    answers = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("file"), F.floor(F.col("l_orderkey") / 512).alias("page")).agg(F.to_json(F.collect_list(one)).alias("content"))
    return dumps.blame(answers, ["file"])


@query("SELECT l_suppkey AS file, (l_orderkey * 10)::INT AS start_line, (l_orderkey * 10 + l_quantity::INT % 10)::INT AS end_line, 'c' || l_orderkey AS sha, 'u' || l_partkey % 7 || '@h' AS author_email, CASE WHEN l_partkey % 3 > 0 THEN 'user' || l_partkey % 7 END AS author_login FROM lineitem")
def blame_dump(spark, sf):
    return _blames(spark, sf, users=True).select("file", "start_line", "end_line", "sha", "author_email", "author_login")


@query(f"WITH {_BLAME}, s AS (SELECT email, sum(end_line - start_line + 1)::BIGINT AS lines FROM b GROUP BY email) SELECT email, 'User ' || substr(email, 2, 1) AS name, NULL::VARCHAR AS login, lines, floor(lines * 100.0 / sum(lines) OVER () * 10 + 0.5) / 10 AS pct FROM s")
def blame_owners(spark, sf):
    return history.owners(_blames(spark, sf))


@query(
    "WITH h AS (SELECT l_orderkey::VARCHAR AS key, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_quantity) - 1)::INT AS hunk, l_partkey::INT AS p, l_quantity::INT AS q FROM lineitem),"
    " lines AS (SELECT *, unnest([0, 1, 2, 3]) AS k FROM h) SELECT key, hunk, CASE k WHEN 0 THEN 'context' WHEN 1 THEN 'del' ELSE 'add' END AS kind, CASE WHEN k <= 1 THEN p + k END AS old_line, CASE k WHEN 0 THEN q WHEN 2 THEN q + 1 WHEN 3 THEN q + 2 END AS new_line, CASE k WHEN 0 THEN 'same' WHEN 1 THEN '- old' WHEN 2 THEN 'new ' || q ELSE '' END AS text FROM lines"
)
def diff_lines(spark, sf):
    hunk = F.concat(F.lit("@@ -"), F.col("l_partkey").cast("string"), F.lit(",2 +"), F.col("l_quantity").cast("int").cast("string"), F.lit(",3 @@\n same\n-- old\n+new "), F.col("l_quantity").cast("int").cast("string"), F.lit("\n+"))
    patches = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_quantity", hunk.alias("hunk")))).alias("x"))
    return history.parse_patches(patches.select("key", F.array_join("x.hunk", "\n").alias("patch")))


# Manifests and settings ----------------------------------------------------------------------------------------------

_DEPS = "d AS (SELECT DISTINCT l_suppkey AS repo, l_partkey FROM lineitem), v AS (SELECT repo, 'pkg-' || l_partkey AS pkg, p_partkey % 3 AS t, p_size AS size FROM d JOIN part ON p_partkey = l_partkey)"


def _dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """repo, pkg, range, t: a supplier's parts as packages; t tells the kind of range."""
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("repo"), F.col("l_partkey").alias("p_partkey")).distinct().join(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    t = F.col("p_partkey") % 3
    return d.select("repo", text("pkg-", "p_partkey").alias("pkg"), F.concat(F.when(t == 0, "^").when(t == 1, ">=").otherwise(""), F.col("p_size").cast("string"), F.lit(".2.0")).alias("range"), t.alias("t"), F.col("p_size").alias("size"))


def _manifests(spark: SparkSession, sf: str) -> DataFrame:
    pairs = lambda when: F.map_from_entries(F.collect_list(F.when(when, F.struct("pkg", "range"))))
    # A repository names each package once, and there are only so many parts.
    return _dependencies(spark, sf).groupBy("repo").agg(answer(dependencies=pairs(F.col("t") < 2), devDependencies=pairs(F.col("t") == 2)).alias("content"))


@query(f"WITH {_DEPS} SELECT repo, pkg, size || '.2.0' AS version, t = 2 AS is_dev FROM v")
def manifest_dependencies(spark, sf):
    return repo.manifest_deps(_manifests(spark, sf))


@query(f"WITH {_DEPS} SELECT repo, pkg, size || '.2.0' AS version, 'CVE-' || size % 10 AS id, CASE WHEN size % 4 > 0 THEN '20.10' END AS fixed, CASE WHEN size % 2 = 0 THEN 'high' ELSE 'low' END AS severity FROM v WHERE size >= 9 AND (size % 4 = 0 OR size < 20 OR size = 20)")
def vulnerable_ranges(spark, sf):
    deps = repo.manifest_deps(_manifests(spark, sf)).select("repo", "pkg", "version")
    size = F.col("p_size")
    ranges = table(spark, sf, "part").select(text("pkg-", "p_partkey").alias("pkg"), F.concat(F.lit("CVE-"), (size % 10).cast("string")).alias("id"), F.lit("9").alias("introduced"), F.when(size % 4 > 0, "20.10").alias("fixed"), F.when(size % 2 == 0, "high").otherwise("low").alias("severity"))
    return supply.vulnerable(deps, ranges)


@query(r"SELECT s_suppkey || '/.github/workflows/ci.yml' AS path, k.line_no, k.rule_id FROM supplier, (VALUES (0, 1, 'gha-dangerous-trigger'), (1, 2, 'gha-permissions-write-all'), (2, 3, 'gha-unpinned-action'), (3, 4, 'gha-script-injection')) k(m, line_no, rule_id) WHERE s_suppkey % 4 = m")
def workflow_issues(spark, sf):
    bad = lambda m, yes, no: F.when(F.col("s_suppkey") % 4 == m, yes).otherwise(no)
    lines = F.concat_ws("\n", bad(0, "on: pull_request_target", "on: push"), bad(1, "permissions: write-all", "permissions: read-all"), bad(2, " - uses: a/b@v4", " - uses: a/b@0123456789012345678901234567890123456789"), bad(3, " run: echo ${{ github.event.issue.title }}", " run: echo ${{ github.sha }}"))
    return supply.workflow_issues(table(spark, sf, "supplier").select(text("s_suppkey", "/.github/workflows/ci.yml").alias("path"), lines.alias("content")))


@query("SELECT s_suppkey || '/requirements.txt' AS path, 1 + s_suppkey % 3 AS line_no, 'flask' || s_suppkey || '>=1' AS text FROM supplier")
def unpinned_requirements(spark, sf):
    pinned = F.array_repeat(F.lit("django==4.2"), (F.col("s_suppkey") % 3).cast("int"))
    content = F.array_join(F.concat(pinned, F.array(text("flask", "s_suppkey", ">=1"), F.lit("# note"), F.lit("-r base.txt"))), "\n")
    return supply.unpinned_requirements(table(spark, sf, "supplier").select(text("s_suppkey", "/requirements.txt").alias("path"), content.alias("content"))).select("path", F.col("line_no").cast("long").alias("line_no"), "text")


@query("SELECT s_suppkey || '/.npmrc' AS path, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 3 END AS line_no, CASE WHEN s_suppkey % 2 = 0 THEN 'npmrc-auth' ELSE 'http-registry' END AS rule_id FROM supplier")
def npmrc_issues(spark, sf):
    content = F.when(F.col("s_suppkey") % 2 == 0, text("# _authToken=x\n//r/:_authToken=t", "s_suppkey", "\nregistry=https://r")).otherwise(F.lit("//r/:_authToken=${TOKEN}\n\nregistry = http://r"))
    return supply.npmrc_issues(table(spark, sf, "supplier").select(text("s_suppkey", "/.npmrc").alias("path"), content.alias("content")))


@query("WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey % 3 = 1) SELECT l_suppkey || '/package-lock.json' AS path, count(*) AS missing, min('node_modules/p' || l_partkey) AS first FROM d GROUP BY l_suppkey")
def lockfile_integrity(spark, sf):
    d = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    t = F.col("l_partkey") % 3
    entry = F.struct(F.when(t < 2, F.lit("https://r/p.tgz")).alias("resolved"), F.when(t == 0, F.lit("sha512-x")).alias("integrity"))
    locks = d.groupBy("l_suppkey").agg(answer(packages=F.map_from_entries(F.collect_list(F.struct(text("node_modules/p", "l_partkey").alias("k"), entry.alias("v"))))).alias("content"))
    return supply.lockfile_integrity(locks.select(text("l_suppkey", "/package-lock.json").alias("path"), "content"))


@query("SELECT p_partkey, p_size || '.0' AS version FROM part")
def version_prefixes(spark, sf):
    p = table(spark, sf, "part")
    sign = F.get(F.array(*map(F.lit, ("^", "~", ">=", "<", "=", "v", "<= ", ""))), (F.col("p_partkey") % 8).cast("int"))
    return p.select("p_partkey", strip_version(F.concat(F.lit(" "), sign, F.col("p_size").cast("string"), F.lit(".0"))).alias("version"))


# Repositories and paths ----------------------------------------------------------------------------------------------


@query("WITH f AS (SELECT 's' || s_suppkey AS full_name, 's' || (s_suppkey - s_suppkey % 3) AS parent, s_suppkey FROM supplier WHERE s_suppkey % 3 > 0) SELECT DISTINCT least(f.full_name, parent) AS a, greatest(f.full_name, parent) AS b, parent FROM f UNION SELECT min(full_name), max(full_name), parent FROM f GROUP BY parent HAVING count(*) > 1")
def fork_relations(spark, sf):
    k = F.col("s_suppkey")
    return compare.fork_relations(table(spark, sf, "supplier").select(text("s", "s_suppkey").alias("full_name"), (k % 3 > 0).alias("is_fork"), F.when(k % 3 > 0, F.concat(F.lit("s"), (k - k % 3).cast("string"))).alias("parent_full_name")))


@query("SELECT repo, sum(n)::BIGINT AS files, sum(lines)::BIGINT AS lines, '{' || string_agg('\"' || p_type || '\":' || n, ',' ORDER BY p_type) || '}' AS languages FROM (SELECT p_brand AS repo, p_type, count(*) AS n, sum(floor(p_size * 10 / 25.0 + 0.5)) AS lines FROM part GROUP BY p_brand, p_type) GROUP BY repo")
def repository_metrics(spark, sf):
    p = table(spark, sf, "part")
    return compare.repository_metrics(p.select(F.col("p_brand").alias("repo"), text("src/", "p_partkey").alias("path"), (F.col("p_size") * 10).alias("size"), F.col("p_type").alias("language"))).select("repo", "files", "lines", F.to_json("languages").alias("languages"))


@query("SELECT s_suppkey AS id, CASE WHEN k < 4 THEN 'n' || s_nationkey END AS owner, CASE WHEN k < 4 THEN 'r' || s_suppkey END AS repo, CASE WHEN k IN (1, 2) THEN 'main' END AS branch, CASE WHEN k = 2 THEN 'src/a.ts' END AS path, CASE WHEN k < 4 THEN '/n' || s_nationkey || '/r' || s_suppkey || '?view=issues' END AS link FROM (SELECT *, s_suppkey % 5 AS k FROM supplier)")
def repository_urls(spark, sf):
    k = F.col("s_suppkey") % 5
    url = F.concat(F.when(k == 0, "").when(k == 4, "https://example.com/").otherwise("https://github.com/"), text("n", "s_nationkey", "/r", "s_suppkey"), F.when(k == 1, "/tree/main").when(k == 2, "/blob/main/src/a.ts?x=1").when(k == 3, ".git").otherwise(""))
    r = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), repository(url).alias("r"))
    return r.select("id", "r.owner", "r.repo", "r.branch", "r.path", share_link(F.col("r.owner"), F.col("r.repo"), F.lit("issues")).alias("link"))


_PATH = "regexp_replace(url, '^https?://', '')"


@query(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a/' || rtrim({_PATH}, '/') END AS resolved, rtrim({_PATH}, '/') AS normal, trim(regexp_replace({_PATH}, '[^a-zA-Z0-9]+', '_', 'g'), '_') AS id, CASE WHEN len(string_split({_PATH}, '/')) <= 2 THEN {_PATH} ELSE split_part({_PATH}, '/', 1) || '/.../' || list_extract(string_split({_PATH}, '/'), -1) END AS short, split_part({_PATH}, '/', 1) AS top FROM pages")
def path_functions(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    up = F.concat(F.when(F.col("page_id") % 2 == 0, "../").otherwise("../../../"), F.col("path"))
    return p.select("page_id", resolve_path(F.lit("a/b"), up).alias("resolved"), normalize_path(F.concat(F.lit("./x/../"), F.col("path"))).alias("normal"), node_id(F.col("path")).alias("id"), short_path(F.col("path")).alias("short"), top_folder(F.col("path")).alias("top"))


def _listed(values) -> str:
    return "(" + ", ".join(map(_sql, values)) + ")"


@query(f"WITH {_FILES} SELECT ext, count(*) AS n FROM files GROUP BY ext ORDER BY n DESC, ext LIMIT 8")
def extension_pie(spark, sf):
    return tools.extension_pie(document_files(spark, sf))


@query(f"WITH {_FILES} SELECT ext, CASE {' '.join(f'WHEN ext = {_sql(e)} THEN {_sql(x)}' for e, x in parse.LANGUAGES.items())} END AS language, ext IN {_listed(tools.CODE)} AS code, ext IN {_listed(repo.INDEXABLE)} AS indexed, count(*) AS n FROM files GROUP BY ALL")
def language_maps(spark, sf):
    f = document_files(spark, sf).select("path", F.length("content").alias("size"))
    marked = f.join(tools.code_files(f).select("path", F.lit(True).alias("code")), "path", "left").join(repo.indexable(f).select("path", F.lit(True).alias("indexed")), "path", "left")
    language = parse.language_of(F.col("path"))
    return marked.groupBy(F.regexp_extract("path", "[^.]*$", 0).alias("ext"), F.nullif(language, F.lit("")).alias("language"), F.coalesce("code", F.lit(False)).alias("code"), F.coalesce("indexed", F.lit(False)).alias("indexed")).agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT max(o_orderdate)::DATE AS now FROM orders), d AS (SELECT date_diff('day', o_orderdate::DATE, now) AS d FROM orders, n) SELECT CASE WHEN d < 1 THEN 'today' WHEN d < 30 THEN d || 'd' WHEN d < 365 THEN d // 30 || 'mo' ELSE d // 365 || 'y' END AS label, count(*) AS n FROM d GROUP BY 1")
def relative_times(spark, sf):
    o = table(spark, sf, "orders")
    now = F.to_date(F.lit(o.agg(F.max("o_orderdate")).first()[0]))
    return o.select(history.since(F.to_date("o_orderdate"), now).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


# Tables as they are --------------------------------------------------------------------------------------------------


@query("SELECT 'demo' AS repo, lang AS language, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, min(doc_id) LIMIT 1")
def primary_language_documents(spark, sf):
    return structure.primary_language(table(spark, sf, "documents").select(F.lit("demo").alias("repo"), F.col("lang").alias("language"), F.col("doc_id").alias("ordinal")), ["repo"])


@query("SELECT lang AS repo, count(*) AS n FROM documents GROUP BY lang")
def unit_counts(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("repo")).agg(F.count("*").alias("n"))


@query("SELECT 'c' || n_regionkey AS component, 'r' || n_regionkey AS node FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
def connectors_of_regions(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    return graph.connectors(spark, n).select(F.regexp_replace("node", "r", "c").alias("component"), "node")


@query("SELECT 'c' || n_regionkey AS component, count(*) AS size, string_agg('n' || n_nationkey, ',' ORDER BY 'n' || n_nationkey) AS nodes FROM nation GROUP BY n_regionkey HAVING count(*) >= 2")
def graph_clusters(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("c"), "n_regionkey").alias("component"))
    return graph.clusters(n).withColumn("nodes", F.array_join("nodes", ","))


@query("WITH c AS (SELECT o_custkey::VARCHAR AS author, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, author LIMIT 15) SELECT * FROM t UNION ALL SELECT '+' || count(*) || ' more', sum(n)::BIGINT FROM c WHERE author NOT IN (SELECT author FROM t)")
def commits_by_author(spark, sf):
    return history.by_author(table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("author")))


@query("SELECT p_type, s_nationkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_type, s_nationkey")
def join_dim_star(spark, sf):
    li, p, s = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("p_type", "s_nationkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("WITH d AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n FROM d WHERE n >= (SELECT avg(n) FROM d)")
def sql_facade(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("lodestone_documents")
    return spark.sql("WITH d AS (SELECT source, count(*) AS n FROM lodestone_documents GROUP BY source) SELECT source, n FROM d WHERE n >= (SELECT avg(n) FROM d)")


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines FROM documents")
def sql_registered_functions(spark, sf):
    register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("lodestone_documents")
    return spark.sql("SELECT doc_id, lodestone_line_count(text) AS lines FROM lodestone_documents")


# Code ----------------------------------------------------------------------------------------------------------------


@query(
    f"WITH {_PARTS}, {_MORE} SELECT path, 'Part' || k AS name, NULL::VARCHAR AS base, '' AS interfaces, false AS is_abstract FROM parts"
    " UNION ALL SELECT path, x.name || k, 'Base', interfaces, is_abstract FROM more JOIN (VALUES (0, 'Part', '', false), (3, 'Box', 'Closable|Open', true)) x(m, name, interfaces, is_abstract) ON m = t"
)
def classes_table(spark, sf):
    return structure.classes(several_languages(spark, sf)).select("path", "name", "base", F.array_join("interfaces", "|").alias("interfaces"), "is_abstract")


@query(
    f"WITH {_PARTS}, {_MORE} SELECT path, './p' || q AS source, 'keep' || q AS names, false AS is_default FROM parts"
    " UNION ALL SELECT path, CASE WHEN source = '.m' THEN source || k ELSE source END, names, is_default FROM more JOIN (VALUES (0, 'os', 'os', false), (0, 'flask', 'Flask,g', false), (0, '.m', 'Base', false), (3, 'react', 'React,useState', true), (3, './q', 'Q', false)) x(m, source, names, is_default) ON m = t"
)
def import_specifiers(spark, sf):
    return structure.specifiers(several_languages(spark, sf)).select("path", "source", F.array_join("names", ",").alias("names"), "is_default")


@query(f"WITH {_PARTS} SELECT path FROM parts WHERE contains(path, '7')")
def path_matches(spark, sf):
    return tools.path_matches(code_files(spark, sf), "7").select("path")


@query(f"WITH {_PARTS}, m AS (SELECT q FROM parts WHERE k <> q GROUP BY q ORDER BY count(*) DESC, 'src/p' || q || '.ts' LIMIT 1) SELECT path FROM parts WHERE q = (SELECT q FROM m) AND k <> q ORDER BY path LIMIT 30")
def importers_of(spark, sf):
    """The first importers of the file that is imported most."""
    files = typescript(spark, sf)
    edges = parse.resolve(parse.imports(files), files)
    target = edges.groupBy("dst").count().orderBy(F.desc("count"), "dst").first()
    return tools.importers_of(edges, target["dst"])


@query(f"WITH {_FILES} SELECT DISTINCT split_part(path, '/', 2) AS name, 'blob' AS type FROM files WHERE split_part(path, '/', 1) = 'src1'")
def folder_listing(spark, sf):
    return tools.listing(document_files(spark, sf).select("path", F.lit("blob").alias("type")), "src1")


@query(f"WITH {_FILES} SELECT path, 'blob' AS type, split_part(path, '/', 1) AS parent, 2 AS depth FROM files")
def tree_order(spark, sf):
    return repo.hierarchy(document_files(spark, sf).select("path", F.lit("blob").alias("type")))


@query(f"WITH {_FILES} SELECT path FROM files WHERE path LIKE '%.py' OR path LIKE 'src1/%' OR contains(path, '99')")
def glob_filtered(spark, sf):
    return document_files(spark, sf).where(glob_filter(F.col("path"), "*.py, src1/*, 99")).select("path")


@query("SELECT doc_id AS path, CASE WHEN doc_id % 6 = 0 THEN 'new ' || lang ELSE text END AS content FROM documents WHERE doc_id % 6 <> 1 UNION ALL SELECT -1 - doc_id, 'added' FROM documents WHERE doc_id % 50 = 0")
def index_upserted(spark, sf):
    d = table(spark, sf, "documents")
    base = d.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    changes = d.where("doc_id % 6 < 2").select(F.col("doc_id").alias("path"), F.concat(F.lit("new "), "lang").alias("content"), (F.col("doc_id") % 6 == 1).alias("removed"))
    added = d.where("doc_id % 50 = 0").select((-1 - F.col("doc_id")).alias("path"), F.lit("added").alias("content"), F.lit(False).alias("removed"))
    return search.upsert(base, changes.unionByName(added))


@query("SELECT doc_id, replace(text, 'License', 'Licence') AS text FROM documents")
def replaced_everywhere(spark, sf):
    return search.replace_all(table(spark, sf, "documents").select("doc_id", "text"), "License", "Licence", content="text", case_sensitive=True)


@query(f"WITH {_PARTS}, e AS (SELECT path AS src, 'src/p' || q || '.ts' AS dst FROM parts WHERE k <> q) SELECT a.src AS entry, a.dst AS child, CASE WHEN b.dst <> a.src THEN b.dst END AS grandchild FROM e a LEFT JOIN e b ON b.src = a.dst WHERE a.src LIKE 'src/p1%'")
def entry_tree(spark, sf):
    files = typescript(spark, sf)
    return graph.entry_tree(parse.resolve(parse.imports(files), files), files.where("path like 'src/p1%'").select(F.col("path").alias("node")))


@query(f"WITH RECURSIVE {_PARTS}, w AS (SELECT k AS start, k, q, 1 AS steps FROM parts WHERE k <> q UNION SELECT w.start, p.k, p.q, steps + 1 FROM w JOIN parts p ON p.k = w.q WHERE steps < 400 AND p.k <> w.start), c AS (SELECT DISTINCT start AS k FROM w WHERE q = start) SELECT path AS src, 'src/p' || q || '.ts' AS dst FROM parts WHERE k IN (SELECT k FROM c) OR (k = q AND false)")
def cycle_edges(spark, sf):
    """Imports that lie on circles of imports."""
    files = typescript(spark, sf)
    return graph.cycle_edges(spark, parse.resolve(parse.imports(files), files))


@query(f"WITH {_PARTS}, e AS (SELECT path AS src, 'src/p' || q || '.ts' AS dst FROM parts WHERE k <> q) SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM parts) AS files, floor((SELECT count(*) FROM e) / (SELECT count(*) FROM parts) * 10 + 0.5) / 10 AS avg_deps, (SELECT dst FROM e GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1) AS most_imported, (SELECT src FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1) AS most_dependent")
def graph_common_stats(spark, sf):
    files = typescript(spark, sf)
    return graph.common_stats(files, parse.resolve(parse.imports(files), files))


@query("SELECT source AS folder, count(*) AS files, list_extract(['entry', 'hub', 'connector', 'regular', 'leaf', 'orphan'], 1 + min(doc_id % 6)::INT) AS role FROM documents GROUP BY source")
def folder_roles(spark, sf):
    d = table(spark, sf, "documents")
    return graph.folder_roles(d.select(F.concat("source", F.lit("/d"), F.col("doc_id").cast("string")).alias("path"), F.get(F.array(*map(F.lit, graph.ROLE_ORDER)), (F.col("doc_id") % 6).cast("int")).alias("role")))


@query("SELECT s_suppkey AS project, n || ' circular dependency pair' || CASE WHEN n > 1 THEN 's' ELSE '' END || ' detected' AS note FROM (SELECT s_suppkey, s_suppkey % 4 AS n FROM supplier) WHERE n > 0 UNION ALL SELECT s_suppkey, s_suppkey % 13 || ' orphan files may be dead code' FROM supplier WHERE s_suppkey % 13 > 5 UNION ALL SELECT s_suppkey, 'deepest dependency chain is ' || s_nationkey || ' levels' FROM supplier WHERE s_nationkey > 8 UNION ALL SELECT s_suppkey, n || ' file' || CASE WHEN n > 1 THEN 's' ELSE '' END || ' imported by more than 30% of the project' FROM (SELECT s_suppkey, s_suppkey % 3 AS n FROM supplier) WHERE n > 0 UNION ALL SELECT s_suppkey, n || ' connector file' || CASE WHEN n > 1 THEN 's' ELSE '' END || ' would split the graph' FROM (SELECT s_suppkey, s_suppkey % 5 AS n FROM supplier) WHERE n > 0")
def graph_health(spark, sf):
    k = F.col("s_suppkey")
    return graph.health_issues(table(spark, sf, "supplier").select(k.alias("project"), F.lit(50).alias("files"), (k % 4).alias("cycles"), (k % 13).alias("orphans"), F.col("s_nationkey").alias("depth"), (k % 5).alias("split"), (k % 3).alias("coupled")))


_REPORT = f"{_DEPS}, r AS (SELECT DISTINCT pkg, size || '.2.0' AS version, t = 2 AS is_dev, CASE t WHEN 0 THEN (size + 1) || '.0.0' WHEN 1 THEN size || '.3.0' ELSE size || '.2.0' END AS latest, CASE WHEN size % 5 = 0 THEN 2 ELSE 0 END::BIGINT AS cves, CASE t WHEN 0 THEN 'major' WHEN 1 THEN 'minor' END AS behind FROM v)"


def _report(spark: SparkSession, sf: str) -> DataFrame:
    deps = repo.manifest_deps(_manifests(spark, sf)).select("pkg", "version", "is_dev").distinct()
    p, t, size = table(spark, sf, "part"), F.col("p_partkey") % 3, F.col("p_size")
    pkg = text("pkg-", "p_partkey").alias("pkg")
    latest = F.concat(F.when(t == 0, size + 1).otherwise(size).cast("string"), F.when(t == 0, ".0.0").when(t == 1, ".3.0").otherwise(".2.0"))
    registry = p.select(pkg, latest.alias("latest"), size.alias("downloads"))
    cves = p.where(size % 5 == 0).select(pkg, F.explode(F.array(F.lit("high"), F.lit("low"))).alias("severity"))
    return supply.dependency_report(deps, registry, cves)


@query(f"WITH {_REPORT} SELECT pkg, version, is_dev, latest, cves, behind FROM r")
def dependency_report(spark, sf):
    return _report(spark, sf).select("pkg", "version", "is_dev", "latest", "cves", "behind")


@query(f"WITH {_REPORT} SELECT count(*) AS total, sum(cves)::BIGINT AS cves, count(*) FILTER (WHERE cves > 0) AS vulnerable, count(*) FILTER (WHERE behind = 'major') AS major, count(*) FILTER (WHERE behind = 'minor') AS minor, 0::BIGINT AS patch, count(behind) AS outdated FROM r")
def dependency_summary(spark, sf):
    return supply.dependency_summary(_report(spark, sf))


@query("SELECT p_partkey, p_partkey % 4 < 3 AS boilerplate FROM part")
def boilerplate_paths(spark, sf):
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, text(".github/x", "p_partkey", ".yml")).when(k == 1, F.lit("pkg/LICENSE")).when(k == 2, text("tsconfig.", "p_partkey", ".json")).otherwise(text("src/a", "p_partkey", ".ts"))
    return table(spark, sf, "part").select("p_partkey", compare.boilerplate(path).alias("boilerplate"))


_SAID = "CASE o_orderstatus WHEN 'F' THEN 'true-positive' WHEN 'O' THEN 'false-positive' ELSE 'uncertain' END"


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    word = F.when(s == "F", "True-Positive").when(s == "O", "false-positive").otherwise("maybe")
    body = answer(verdict=word, confidence=F.lit("high"), reasoning=text("order ", "o_orderkey"), suggestedSeverity=F.when(k % 2 == 0, "critical").when(k % 5 == 0, "huge"))
    plain = F.when(s == "F", "This is a true positive.").when(s == "O", "I call it a false-positive").otherwise("no idea")
    return table(spark, sf, "orders").select(k.alias("issue_id"), F.when(k % 3 == 0, F.concat(F.lit("Sure: "), body, F.lit(" done"))).when(k % 3 == 1, body).otherwise(plain).alias("response"))


@query(f"SELECT o_orderkey AS issue_id, {_SAID} AS verdict, CASE WHEN o_orderkey % 3 < 2 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN o_orderkey % 3 < 2 THEN 'order ' || o_orderkey WHEN o_orderstatus = 'F' THEN 'This is a true positive.' WHEN o_orderstatus = 'O' THEN 'I call it a false-positive' ELSE 'no idea' END AS reasoning, CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 2 = 0 THEN 'critical' END AS suggested_severity FROM orders")
def ai_verdicts(spark, sf):
    return fixes.verdicts(_answers(spark, sf)).select("issue_id", "verdict", "confidence", "reasoning", "suggested_severity")


@query(f"SELECT {_SAID} AS verdict, count(*) AS n FROM orders GROUP BY 1")
def verdict_counts(spark, sf):
    return fixes.verdicts(_answers(spark, sf)).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'k = \"[REDACTED]\"' WHEN 1 THEN 'Authorization: Bearer [REDACTED] end' WHEN 2 THEN 'postgres://u:[REDACTED]@h/db' WHEN 3 THEN 'api_key=[REDACTED];' ELSE 'x = \"' || p_name || '\"' END AS text FROM part")
def scrubbed_secrets(spark, sf):
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, text('k = "sk_live_abcd', "p_partkey", 'efgh12"')).when(k == 1, text("Authorization: Bearer abc.def-ghi_", "p_partkey", " end")).when(k == 2, text("postgres://u:long", "p_partkey", "password@h/db"))
    raw = raw.when(k == 3, text("api_key = qwertyui", "p_partkey", ";")).otherwise(text('x = "', "p_name", '"'))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), fixes.scrub(raw).alias("text"))


@query(f"WITH {_PARTS} SELECT path, '    ' || lpad((12 + 3 * n)::VARCHAR, 4, ' ') || ' |   const use = () => {{' || chr(10) || '>>> ' || lpad((13 + 3 * n)::VARCHAR, 4, ' ') || ' |     db.query(moved)' || chr(10) || '    ' || lpad((14 + 3 * n)::VARCHAR, 4, ' ') || ' |   }}' AS excerpt FROM parts")
def finding_excerpts(spark, sf):
    files = code_files(spark, sf)
    hits = search.search(files, "db.query", case_sensitive=True).select("path", "line_no")
    return fixes.excerpt(hits, files, 1).select("path", "excerpt")


@query(f"WITH {_PARTS} SELECT path, 2 AS line_no FROM parts")
def comment_lines(spark, sf):
    return context.lines_in_context(code_files(spark, sf)).where("is_comment").select("path", "line_no")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/' || p_brand WHEN 1 THEN '/shop/:id' WHEN 2 THEN '/api/x' || p_partkey ELSE '/docs/:slug*' END AS route, CASE WHEN p_partkey % 4 = 2 THEN 'api' ELSE 'page' END AS kind FROM part")
def file_routes(spark, sf):
    k = F.col("p_partkey") % 4
    inner = F.when(k == 0, text("(main)/", "p_brand", "/page.tsx")).when(k == 1, F.lit("shop/@side/[id]/page.jsx")).when(k == 2, text("api/x", "p_partkey", "/route.ts")).otherwise(F.lit("docs/[[...slug]]/page.tsx"))
    paths = table(spark, sf, "part").select(F.concat(text("r", "p_partkey"), F.lit("/app/"), inner).alias("path"))
    found = structure.file_routes(paths)
    return found.select(F.regexp_extract("path", "^r([0-9]+)/", 1).cast("long").alias("p_partkey"), "route", "kind")


@query("SELECT s_suppkey || '.js' AS path, upper(m.m) AS method, '/v' || s_suppkey || '/' || m.m AS route FROM supplier, (VALUES ('get'), ('post')) m(m)")
def web_routes(spark, sf):
    line = lambda m: text(f"router.{m}('/v", "s_suppkey", f"/{m}', (req, res) => res.end())")
    return parse.routes(table(spark, sf, "supplier").select(text("s_suppkey", ".js").alias("path"), F.concat_ws("\n", line("get"), line("post"), line("get")).alias("content")))


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, 'pie title Parts' || chr(10) || string_agg('  \"' || p_type || '\" : ' || n, chr(10) ORDER BY n DESC, '  \"' || p_type || '\" : ' || n) AS text FROM c GROUP BY p_brand")
def diagram_pie(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_brand", F.col("p_type").alias("key")).agg(F.count("*").alias("n"))
    return report.pie_chart(counts, ["p_brand"], "Parts")
