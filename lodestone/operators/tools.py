"""Look-ups that a reader of a repository asks for: files, symbols, matches with places, excerpts within a budget, tours.

files: (path, content, ordinal). Limits are parameters where they are the feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import extension, line_count, parent_path, resolve_path, search_pattern, split_lines
from lodestone.operators.search import to_lines

# Files with code to take structure from; names of files that matter.
CODE = tuple("ts tsx js jsx mts mjs py rs go java".split())
SIGNIFICANT = r"^(?:index|main|app|server|page|layout|route)\.\w+$"
ENTRY_NAME = r"(?:index|main|app|page)\.(?:ts|tsx|js|jsx)$"
TEST_NAME, CONFIG_NAME = r"\.test\.|\.spec\.|__tests__", r"tsconfig|package\.json"
GENERATED = (
    r"(?:^|/)node_modules/", r"(?:^|/)dist/", r"(?:^|/)build/", r"(?:^|/)\.next/", r"(?:^|/)coverage/", r"\.min\.(?:js|css)$", r"\.map$", r"\.lock$", r"package-lock\.json$", r"(?:^|/)vendor/",
)


def match_places(files: DataFrame, query: str, **how) -> DataFrame:
    """path, line_no, column_no (from 0), length, match: every match of a query. A match of no length counts once for its line."""
    pattern = search_pattern(query, **how)
    lines = to_lines(files)
    if pattern is None:
        return lines.limit(0).select("path", "line_no", F.lit(0).alias("column_no"), F.lit(0).alias("length"), F.lit("").alias("match"))
    marked = F.regexp_replace("text", f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})", "\u0001$1\u0002")
    # Marks around the matches, cut at the opening ones: a match's place is the length of all before it without marks.
    parts = F.split(marked, "\u0001")
    found = lines.where(F.col("text").rlike(pattern)).select("path", "line_no", parts.alias("parts"))
    bare = F.transform("parts", lambda p: F.length(p) - F.when(p.contains("\u0002"), 1).otherwise(0))
    at = lambda i: F.aggregate(F.slice(bare, 1, i), F.lit(0), lambda a, n: a + n)
    place = lambda i: F.struct(at(i).alias("column_no"), F.substring_index(F.get("parts", i), "\u0002", 1).alias("match"))
    out = found.select("path", "line_no", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), place)).alias("x")).select("path", "line_no", "x.column_no", F.length("x.match").alias("length"), "x.match")
    first = F.row_number().over(Window.partitionBy("path", "line_no").orderBy("column_no"))
    empty = F.min("length").over(Window.partitionBy("path", "line_no")) == 0
    return out.withColumn("k", first).withColumn("e", empty).where("not e or k = 1").drop("k", "e")


def path_matches(files: DataFrame, query: str) -> DataFrame:
    """Files whose path holds the query in either case; a blank one matches none."""
    return files.where(F.lower("path").contains(query.lower())) if query.strip() else files.limit(0)


def plain_files(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("type").isin("file", "blob"))


def written_by_hand(files: DataFrame) -> DataFrame:
    """Files that no tool generates."""
    return files.where(~F.col("path").rlike("|".join(GENERATED)))


def code_files(files: DataFrame) -> DataFrame:
    return files.where(extension(F.col("path")).isin(*CODE))


def search_more(files: DataFrame, done: DataFrame, query: str, batch: int = 100, **how) -> tuple[DataFrame, DataFrame]:
    """The matches (path, line_no, text, n) in the next `batch` files, by order, that aren't in `done` (path); and the paths that
    remain after them."""
    from lodestone.operators.search import search

    left = files.join(done.select("path").distinct(), "path", "left_anti")
    now = left.orderBy("ordinal", "path").limit(batch)
    rest = left.select("path").join(now.select("path"), "path", "left_anti")
    return search(now, query, **how), rest


def find_file(files: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (query) -> query, path: the file with that path; else the first that ends with it behind a slash, else at all. An
    equi-join on the last segment: what ends with a query ends with that."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    q = asked.select("query").distinct().withColumn("name", last("query"))
    by_name = files.select("path", "ordinal", last("path").alias("name"))
    # A query without a slash may be only the end of a file's name: all ends of names are keys.
    ends = by_name.select("path", "ordinal", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda k: F.substring(F.col("name"), k, F.length("name")))).alias("name"))
    hit = q.join(ends, "name").where(F.col("path").endswith(F.col("query")))
    rank = F.when(F.col("path") == F.col("query"), 0).when(F.col("path").endswith(F.concat(F.lit("/"), F.col("query"))), 1).otherwise(2)
    return hit.groupBy("query").agg(F.min_by("path", F.struct(rank.alias("r"), "ordinal", "path")).alias("path"))


STRIPPED = r"(?i)\.(?:tsx?|jsx?|mts|mjs|py|rs|go|java)$"


def resolve_sources(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, source) -> path, source, dst: the file that an import names, as written, without its extension, or as a folder's
    index; the first of equals. Sources above the root, and packages, have none and give no row."""
    source = F.col("source")
    base = F.when(source.startswith("@/"), F.substring(source, 3, F.length(source))).when(source.startswith("."), resolve_path(parent_path(F.col("path")), source)).otherwise(source)
    bare = F.regexp_replace("path", STRIPPED, "")
    keys = files.select(F.col("path").alias("dst"), "ordinal", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("rank"), F.col("path").alias("base")), F.struct(F.lit(1).alias("rank"), bare.alias("base")), F.when(bare.rlike(r"/(?:index|__init__)$"), F.struct(F.lit(2).alias("rank"), F.regexp_replace(bare, r"/(?:index|__init__)$", "").alias("base")))))).alias("k"))
    first = keys.groupBy(F.col("k.base").alias("base"), F.col("k.rank").alias("rank")).agg(F.min_by("dst", F.struct("ordinal", "dst")).alias("dst"))
    tried = imports.select("path", "source", base.alias("base")).where("base is not null").join(first, "base")
    return tried.groupBy("path", "source").agg(F.min_by("dst", "rank").alias("dst"))


def importers_of(edges: DataFrame, target: str, limit: int = 30) -> DataFrame:
    """The first `limit` files that import the target."""
    return edges.where((F.col("dst") == target) & (F.col("src") != target)).select(F.col("src").alias("path")).distinct().orderBy("path").limit(limit)


def find_symbol(symbols: DataFrame, files: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Declarations whose name holds the text in either case, in file order, `limit` of them."""
    found = symbols.where(F.lower("name").contains(name.lower())).join(files.select("path", "ordinal"), "path")
    return found.orderBy("ordinal", "line_no").limit(limit).drop("ordinal")


def search_files(files: DataFrame, query: str, limit: int = 15, places: int = 5, **how) -> DataFrame:
    """path, kind (path, content), total, lines: files whose path matches, in file order, then those whose lines do, most first;
    `limit` in all, with the first `places` line numbers of each."""
    from lodestone.operators.search import search

    by_path = path_matches(files, query).select("path", "ordinal", F.lit("path").alias("kind"), F.lit(0).cast("long").alias("total"), F.array().cast("array<int>").alias("lines"))
    lines = search(files, query, **how).groupBy("path").agg(F.count("*").alias("total"), F.slice(F.sort_array(F.collect_list("line_no")), 1, places).alias("lines"))
    by_line = files.select("path", "ordinal").join(lines, "path").select("path", "ordinal", F.lit("content").alias("kind"), "total", "lines").join(by_path.select("path"), "path", "left_anti")
    return by_path.unionByName(by_line).orderBy(F.desc("kind"), F.desc("total"), "ordinal").limit(limit).drop("ordinal")


def listing(tree: DataFrame, folder: str = "") -> DataFrame:
    """name, type: what lies in a folder, folders first, then in the order of people's languages."""
    inside = tree.where(parent_path(F.col("path")) == folder)
    return inside.select(F.element_at(F.split("path", "/"), -1).alias("name"), "type").orderBy((~F.col("type").isin("dir", "tree")).cast("int"), F.collate("name", "UNICODE"))


def significance(path: Column, content: Column) -> Column:
    """Points of a file: 10 for a telling name, one for each export line up to 10, 20 less for tests, 5 less for data."""
    name = F.element_at(F.split(path, "/"), -1)
    exports = F.size(F.regexp_extract_all(content, F.lit(r"(?m)^export\s"), 0))
    return F.when(name.rlike(SIGNIFICANT), 10).otherwise(0) + F.least(exports, F.lit(10)) - F.when(path.rlike(TEST_NAME), 20).otherwise(0) - F.when(path.rlike(r"\.(?:json|lock|md)$"), 5).otherwise(0)


def tour(files: DataFrame, stops: int = 8) -> DataFrame:
    """path, points, start, end: the most significant files, with the lines of their first declaration (15 of them)."""
    rows = files.select("path", "ordinal", significance(F.col("path"), F.col("content")).alias("points"), split_lines(F.col("content")).alias("lines"))
    top = rows.orderBy(F.desc("points"), "ordinal").limit(stops)
    first = F.array_min(F.transform("lines", lambda t, i: F.when(t.rlike(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|const|def|func|fn|type|struct)\s+\w+"), i)))
    return top.select("path", "points", F.coalesce(first + 1, F.lit(1)).alias("start"), F.least(F.coalesce(first + 15, F.lit(20)), F.size("lines")).alias("end"))


def overview(files: DataFrame, entries: int = 10, folders: int = 15) -> DataFrame:
    """files, lines, languages (extension and files), folders, has_tests, has_config, entries: one row for a repository."""
    ext = F.element_at(F.split("path", r"\."), -1)
    rows = files.select("path", "ordinal", ext.alias("ext"), F.element_at(F.split("path", "/"), 1).alias("folder"), line_count(F.col("content")).alias("lines"))
    counted = lambda c, n: rows.groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(n).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "k"))).alias("x")).select(F.transform("x", lambda e: F.concat(e["k"], F.lit(":"), (-e["m"]).cast("string"))).alias(c))
    totals = rows.agg(F.count("*").alias("files"), F.sum("lines").cast("long").alias("lines"), F.max(F.col("path").rlike(TEST_NAME)).alias("has_tests"), F.max(F.col("path").rlike(CONFIG_NAME)).alias("has_config"))
    first = rows.where(F.col("path").rlike(ENTRY_NAME)).orderBy("ordinal").limit(entries).agg(F.sort_array(F.collect_list(F.struct("ordinal", "path"))).alias("x")).select(F.transform("x", lambda e: e["path"]).alias("entries"))
    # Each side is one row.
    return totals.crossJoin(F.broadcast(counted("ext", 1000))).crossJoin(F.broadcast(counted("folder", folders))).crossJoin(F.broadcast(first))


def extension_pie(files: DataFrame, top: int = 8) -> DataFrame:
    return files.groupBy(F.element_at(F.split("path", r"\."), -1).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(top)


def pack_pins(pins: DataFrame, files: DataFrame, single: int, total: int, by: str = "reader") -> DataFrame:
    """by, path, taken: pinned files and files of pinned folders (by, pin, place), each once in the order of pins, taken while they
    fit: longer ones than `single`, or than what is left of `total`, are passed over and later ones still tried. A fold over
    the sizes of one reader's files."""
    folder = pins.select(by, "place", F.regexp_replace("pin", "/*$", "").alias("pin"))
    up = files.select("path", "ordinal", F.length("content").alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("pin"))
    hit = folder.join(up, "pin").where("size > 0").groupBy(by, "path", "ordinal", "size").agg(F.min("place").alias("place"))
    listed = hit.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("place", "ordinal", "path", "size"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<path:string,taken:boolean>>").alias("out"))

    def step(a: Column, f: Column) -> Column:
        ok = (f["size"] <= single) & (a["used"] + f["size"] <= total)
        return F.struct((a["used"] + F.when(ok, f["size"]).otherwise(0)).cast("long").alias("used"), F.concat(a["out"], F.array(F.struct(f["path"].alias("path"), ok.alias("taken")))).alias("out"))

    return listed.select(by, F.explode(F.aggregate("all", start, step, lambda a: a["out"])).alias("x")).select(by, "x.*")


def skills(files: DataFrame) -> DataFrame:
    """path, id, name, description, tools, valid, unique: skill files with a front matter; ids are lower-case words with hyphens."""
    head = F.regexp_extract("content", r"(?s)^---\n(.*?)\n---", 1)
    field = lambda k: F.trim(F.regexp_extract("head", rf"(?m)^{k}:[ \t]*(.*)$", 1))
    rows = files.select("path", head.alias("head")).where("head <> ''").select("path", field("id").alias("id"), field("name").alias("name"), field("description").alias("description"), F.filter(F.split(F.regexp_replace(field("tools"), r"[\[\]]", ""), r"\s*,\s*"), lambda t: t != "").alias("tools"))
    return rows.withColumn("valid", F.col("id").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") & (F.col("name") != "")).withColumn("unique", F.count("*").over(Window.partitionBy("id")) == 1)
