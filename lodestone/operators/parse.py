"""Structure of source files: imports, exports, symbols, resolution of imports. files: (path, content, language)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import line_count, normalize_path, parent_path
from lodestone.operators.search import to_lines

# Fixed tables: language by extension, for parsing, for listings and for structural indexes; scans have their own
# (structure.SCANNED_LANGUAGES). They differ and are kept apart.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyw": "python", "go": "go", "rs": "rust", "php": "php", "rb": "ruby", "java": "java",
    "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "swift": "swift", "dart": "dart", "vue": "typescript", "svelte": "typescript",
}
LISTED = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rb": "ruby", "go": "go",
    "rs": "rust", "java": "java", "kt": "kotlin", "swift": "swift", "cs": "csharp", "cpp": "cpp", "c": "c", "h": "c", "hpp": "cpp",
    "php": "php", "vue": "vue", "svelte": "svelte", "html": "html", "css": "css", "scss": "scss", "sass": "sass", "less": "less",
    "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "mdx": "markdown", "sql": "sql", "sh": "shell", "bash": "shell",
    "zsh": "shell", "dockerfile": "dockerfile", "graphql": "graphql", "gql": "graphql",
}
INDEXED = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "rs": "rust", "go": "go", "java": "java",
    "css": "css", "scss": "scss", "html": "html", "json": "json", "md": "markdown", "yaml": "yaml", "yml": "yaml",
}
SCRIPT = ("typescript", "javascript")
#: Patterns whose first group is an import's source, by language.
IMPORTS = {
    "typescript": (r"(?m)^\s*import\s+(?:[^'\";]*?\s+from\s+)?['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)", r"(?m)^\s*export\s+[^'\";]*?\s+from\s+['\"]([^'\"]+)['\"]"),
    "python": (r"(?m)^\s*from\s+([.\w]+)\s+import\b", r"(?m)^\s*import\s+([.\w]+(?:\s*,\s*[.\w]+)*)"),
    "go": (r"(?m)^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"", r"(?m)^\t(?:\w+\s+)?\"([^\"]+)\"\s*$"),
    "rust": (r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;"),
    "php": (r"(?m)^\s*use\s+([\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]"),
}
#: Kind of symbol and the pattern of a line that declares it (first group: its name).
SYMBOLS = {
    "typescript": (("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*[=<]"), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>")),
    "python": (("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")),
    "go": (("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("type", r"^type\s+(\w+)")),
    "rust": (("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)")),
    "php": (("class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)"), ("function", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*function\s+(\w+)")),
}
# Fixed list: extensions that imports leave out, in order; then the same for a folder's index.
CODE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".py", ".go", ".rs", ".php")
SUFFIXES = ("", *CODE_EXTENSIONS, *(f"/index{e}" for e in CODE_EXTENSIONS), "/__init__.py")


def language_of(path: Column, table: dict[str, str] = LANGUAGES) -> Column:
    """The language of a path by its extension (a name without a dot is one itself), or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.lower(F.regexp_extract(path, r"(?:^|[./])(\w+)$", 1)))


def _by_language(language: Column, make, other: Column) -> Column:
    out = other
    for name in IMPORTS:
        names = SCRIPT if name == "typescript" else (name,)
        out = F.when(language.isin(*names), make(name)).otherwise(out)
    return out


def imports(files: DataFrame) -> DataFrame:
    """path, source, external: distinct imports of each file; unknown languages are read as scripts."""
    every = lambda name: F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all("content", F.lit(p), 1) for p in IMPORTS[name]))))
    found = _by_language(F.col("language"), every, every("typescript"))
    found = F.when(F.col("language") == "python", F.flatten(F.transform(found, lambda s: F.split(s, r"\s*,\s*")))).otherwise(found)
    rows = files.select("path", "language", F.explode(F.array_distinct(found)).alias("source"))
    inside = F.col("source").rlike(r"^(?:\.|/|@/|~/|#/)") | ((F.col("language") == "rust") & F.col("source").rlike("^(?:crate|self|super)\\b"))
    return rows.select("path", "source", (~inside | (F.col("language") == "php")).alias("external"))


def package_of(source: Column) -> Column:
    """The package of an external import: two segments with a scope, else one."""
    return F.when(source.startswith("@"), F.regexp_extract(source, "^([^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(source, "^([^/]+)", 1))


def resolve(found: DataFrame, paths: DataFrame) -> DataFrame:
    """src, dst: imports (path, source, external) as edges between files. Candidates stand in order (as written, with
    extensions, as folders, below src/ and app/ for aliases); the first that exists wins.

    An equi-join on bases: a file is what a base and a suffix make if it ends with the suffix after the base, so each file has a row for each of the few suffixes it ends with, and an import
    one for each base. It never broadcasts: paths may be made from tables that are far smaller."""
    own = found.where("not external")
    alias = F.regexp_replace("source", "^(?:@|~|#)/", "")
    relative = normalize_path(F.concat_ws("/", parent_path(F.col("path")), F.col("source")))
    dotted = normalize_path(F.concat_ws("/", parent_path(F.col("path")), F.replace(F.regexp_replace("source", r"^\.", ""), F.lit("."), F.lit("/"))))
    bases = F.when(F.col("source").rlike("^(?:@|~|#)/"), F.array(alias, F.concat(F.lit("src/"), alias), F.concat(F.lit("app/"), alias))).when(F.col("path").endswith(".py"), F.array(dotted)).otherwise(F.array(relative))
    tried = own.select("path", "source", F.posexplode(bases).alias("place", "base"))
    dst = F.col("dst")
    ends = F.array_compact(F.array(*(F.when(dst.endswith(s), F.struct(F.lit(k).alias("suffix"), F.substring(dst, F.lit(1), F.length(dst) - len(s)).alias("base"))) for k, s in enumerate(SUFFIXES))))
    there = paths.select(F.col("path").alias("dst")).distinct().select("dst", F.explode(ends).alias("e")).select("dst", "e.suffix", "e.base")
    hit = tried.join(there.hint("merge"), "base").withColumn("rank", F.col("place") * len(SUFFIXES) + F.col("suffix"))
    return hit.groupBy("path", "source").agg(F.min_by("dst", "rank").alias("dst")).select(F.col("path").alias("src"), "dst").where("src <> dst").distinct()


def symbols(files: DataFrame) -> DataFrame:
    """path, line_no, end_line, kind, name, exported: declarations by line; a symbol ends before the next one."""

    def arms(name: str) -> Column:
        return F.coalesce(*(F.when(F.col("text").rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", p, 1).alias("name"))) for kind, p in SYMBOLS[name]))

    lines = to_lines(files.withColumn("last", line_count(F.col("content"))), keep=("language", "last"))
    marked = lines.withColumn("s", _by_language(F.col("language"), arms, F.lit(None))).where("s is not null")
    after = F.lead("line_no").over(Window.partitionBy("path").orderBy("line_no"))
    exported = F.when(F.col("language").isin(*SCRIPT), F.col("text").rlike(r"^\s*export\b")).when(F.col("language") == "rust", F.col("text").rlike(r"^\s*pub\b")).when(F.col("language") == "go", F.col("s.name").rlike("^[A-Z]")).otherwise(~F.col("s.name").startswith("_"))
    return marked.select("path", "line_no", F.coalesce(after - 1, "last").alias("end_line"), "s.kind", "s.name", exported.alias("exported"))


def block_comment_lines(files: DataFrame, opening: str = "/*", closing: str = "*/") -> DataFrame:
    """path, line_no of lines inside a block comment; the closing line isn't inside. A fold over each file's lines."""
    state = F.aggregate(
        F.split("content", "\n", -1),
        F.struct(F.lit(False).alias("open"), F.array().cast("array<boolean>").alias("inside")),
        lambda a, t: F.struct(F.when(a["open"], ~t.contains(closing)).otherwise(t.contains(opening) & ~F.substring_index(t, opening, -1).contains(closing)).alias("open"), F.concat(a["inside"], F.array(F.when(a["open"], ~t.contains(closing)).otherwise(t.contains(opening) & ~F.substring_index(t, opening, -1).contains(closing)))).alias("inside")),
        lambda a: a["inside"],
    )
    return files.select("path", F.posexplode(state).alias("p", "inside")).where("inside").select("path", (F.col("p") + 1).alias("line_no"))


def structural_issues(files: DataFrame, edges: DataFrame, exports: DataFrame, importers: int = 15) -> DataFrame:
    """path, rule_id, severity: large files, highly coupled ones, modules with exports that nothing imports."""
    n = F.size(F.split("content", "\n", -1))
    large = files.where(n > 400).select("path", F.lit("large-file").alias("rule_id"), F.when(n > 800, "warning").otherwise("info").alias("severity"))
    fan_in = edges.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("n"))
    coupled = fan_in.where(F.col("n") >= importers).select("path", F.lit("high-coupling").alias("rule_id"), F.lit("warning").alias("severity"))
    touched = edges.select(F.col("src").alias("path")).distinct()
    dead = exports.select("path").distinct().join(touched, "path", "left_semi").join(edges.select(F.col("dst").alias("path")), "path", "left_anti").where(~F.col("path").rlike(r"(?:^|/)(?:index|main|page|layout|route)\.\w+$|config")).select("path", F.lit("dead-module").alias("rule_id"), F.lit("info").alias("severity"))
    return large.unionAll(coupled).unionAll(dead)


def routes(files: DataFrame) -> DataFrame:
    """path, method, route: handlers in the styles of common web frameworks."""
    express = F.transform(F.regexp_extract_all("content", F.lit(r"\b(?:app|router)\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"), 0), lambda m: F.struct(F.upper(F.regexp_extract(m, r"\.(\w+)\(", 1)).alias("method"), F.regexp_extract(m, r"['\"]([^'\"]+)['\"]", 1).alias("route")))
    flask = F.transform(F.regexp_extract_all("content", F.lit(r"@\w+\.(route|get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"), 0), lambda m: F.struct(F.when(m.contains(".route("), "GET").otherwise(F.upper(F.regexp_extract(m, r"\.(\w+)\(", 1))).alias("method"), F.regexp_extract(m, r"['\"]([^'\"]+)['\"]", 1).alias("route")))
    inner = F.explode(F.when(F.col("path").endswith(".py"), flask).otherwise(express)).alias("r")
    return files.select("path", inner).select("path", "r.method", "r.route").distinct()
