"""Exports, types, classes, components, frameworks, signatures and structural indexes of source files, by patterns.

files: (path, content, language). All of it works on one row at a time with built-in functions, so nothing is shuffled but
for what is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import extension, line_count, split_lines

SCRIPT = ("typescript", "javascript")
EXPORT = r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|type|interface|enum)\s+(\w+)"
EXPORT_NAME = r"(?m)\bexport\s+default\s+([A-Z]\w*)\s*;?\s*$"
EXPORT_PLAIN = r"\bexport\s+default\s+(?:async\s+)?(?:function|class)\s*(?:\(|\{|extends\b)"
#: Other languages: kind and the pattern whose first group is the exported name.
EXPORTED = {
    "python": (("function", r"(?m)^(?:async\s+)?def\s+([A-Za-z]\w*)"), ("class", r"(?m)^class\s+([A-Za-z]\w*)")),
    "go": (("function", r"(?m)^func\s+(?:\(\w+\s+\*?\w+\)\s+)?([A-Z]\w+)"),),
    "rust": (("function", r"(?m)^pub\s+(?:async\s+)?(?:fn|struct|enum|trait|type|const|static|mod)\s+(\w+)"),),
}
KINDS = ("function", "class", "const|let|var", "type", "interface", "enum")


def first_of_each(items: Column, key: str) -> Column:
    """Structs of an array without those whose key stood before."""
    names = F.transform(items, lambda x: x[key])
    return F.filter(items, lambda x, i: F.array_position(names, x[key]) == i + 1)


def _item(name: Column, kind: Column, default: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("kind"), default.alias("is_default"))


def exports(files: DataFrame) -> DataFrame:
    """path, name, kind, is_default: what each file exports, a name once. Capitalised functions and variables of scripts are
    components; a default without a name is called default. Other languages have none."""
    text = F.col("content")

    def script(m: Column) -> Column:
        kind = F.lit("unknown")
        for k in reversed(KINDS):
            kind = F.when(m.rlike(rf"\b(?:{k})\b"), "variable" if "|" in k else k).otherwise(kind)
        name = F.regexp_extract(m, EXPORT, 1)
        return _item(name, F.when(kind.isin("function", "variable") & name.rlike("^[A-Z]"), "component").otherwise(kind), m.rlike(r"export\s+default"))

    named = F.transform(F.regexp_extract_all(text, F.lit(EXPORT), 0), script)
    ids = F.transform(F.regexp_extract_all(text, F.lit(EXPORT_NAME), 1), lambda n: _item(n, F.lit("unknown"), F.lit(True)))
    plain = F.transform(F.slice(F.regexp_extract_all(text, F.lit(EXPORT_PLAIN), 0), 1, 1), lambda m: _item(F.lit("default"), F.when(m.contains("function"), "function").otherwise("class"), F.lit(True)))
    named_as = lambda kind: lambda n: _item(n, F.lit(kind), F.lit(False))
    out = F.when(F.col("language").isin(*SCRIPT), F.concat(named, ids, plain))
    for language, parts in EXPORTED.items():
        found = F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(p), 1), named_as(kind)) for kind, p in parts))
        out = out.when(F.col("language") == language, found)
    return files.select("path", out.alias("found")).select("path", F.explode(first_of_each(F.col("found"), "name")).alias("x")).select("path", "x.*")


BRACED = r"\{([^}]*(?:\{[^}]*\}[^}]*)*)\}"
INTERFACE = rf"\binterface\s+(\w+)(?:\s+extends\s+([^{{]+))?\s*{BRACED}"
ALIAS = r"\btype\s+(\w+)\s*(?:<[^>]*>)?\s*=\s*([^;]+)"
ENUM = r"\benum\s+(\w+)\s*\{([^}]*)\}"
GO_TYPE = r"\btype\s+(\w+)\s+(?:struct|interface)\s*\{([^}]*)\}"
RUST_STRUCT, RUST_ENUM = r"\bstruct\s+(\w+)(?:<[^>]*>)?\s*\{([^}]*)\}", r"\benum\s+(\w+)(?:<[^>]*>)?\s*\{([^}]*)\}"


def _parts(body: Column, by: str) -> Column:
    pieces = F.transform(F.split(body, by), lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"\s+", " ")), r"\s*;$", ""))
    return F.filter(pieces, lambda p: (p != "") & ~p.rlike(r"^(?://|/\*)"))


def types(files: DataFrame) -> DataFrame:
    """path, name, kind (interface, type, enum), properties, extends: declared types; structs are interfaces."""
    text = F.col("content")
    make = lambda pattern, kind, by, ext=None: F.transform(
        F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda m: F.struct(
            F.regexp_extract(m, pattern, 1).alias("name"), F.lit(kind).alias("kind"), by(F.regexp_extract(m, pattern, ext + 1 if ext else 2)).alias("properties"), (_parts(F.regexp_extract(m, pattern, ext), ",") if ext else F.array().cast("array<string>")).alias("extends")
        ),
    )
    union = lambda body: F.when(body.contains("|"), _parts(body, r"\|")).when(body.contains("&"), _parts(body, "&")).otherwise(F.array(F.trim(body)))
    lines, commas = (lambda b: _parts(b, "\n")), (lambda b: _parts(b, ","))
    names = lambda b: F.filter(F.transform(_parts(b, ","), lambda p: F.trim(F.regexp_extract(p, r"^[^=({]*", 0))), lambda p: p != "")
    out = (
        F.when(F.col("language").isin(*SCRIPT), F.concat(make(INTERFACE, "interface", lines, 2), make(ALIAS, "type", union), make(ENUM, "enum", names)))
        .when(F.col("language") == "go", make(GO_TYPE, "interface", lines))
        .when(F.col("language") == "rust", F.concat(make(RUST_STRUCT, "interface", commas), make(RUST_ENUM, "enum", names)))
    )
    return files.select("path", F.explode(out).alias("x")).select("path", "x.*")


def top_types(found: DataFrame, limit: int = 40) -> DataFrame:
    """The `limit` types with most to tell: those that extend others, then interfaces, enums and aliases, then by properties;
    and the types that they extend."""
    rank = F.when(F.col("kind") == "interface", 0).when(F.col("kind") == "enum", 1).otherwise(2)
    top = found.orderBy(F.desc(F.size("extends") > 0), rank, F.desc(F.size("properties")), "name", "path").limit(limit)
    parents = top.select(F.explode("extends").alias("name")).distinct()
    return top.unionByName(found.join(F.broadcast(parents), "name", "left_semi").select(*found.columns)).distinct()


CLASS = r"(?m)^\s*(?:export\s+)?(?:default\s+)?(abstract\s+)?class\s+(\w+)(?:\s+extends\s+([\w.]+))?(?:\s+implements\s+([\w.,\s]+?))?\s*\{"
PY_CLASS = r"(?m)^()class\s+(\w+)(?:\(([^)]*)\))?()\s*:"


def classes(files: DataFrame) -> DataFrame:
    """path, name, base, interfaces, is_abstract: declared classes of scripts and Python."""

    def make(pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("content", F.lit(pattern), 0), lambda m: F.struct(F.regexp_extract(m, pattern, 2).alias("name"), F.nullif(F.regexp_extract(m, pattern, 3), F.lit("")).alias("base"), _parts(F.regexp_extract(m, pattern, 4), ",").alias("interfaces"), (F.regexp_extract(m, pattern, 1) != "").alias("is_abstract")))

    out = F.when(F.col("language").isin(*SCRIPT), make(CLASS)).when(F.col("language") == "python", make(PY_CLASS))
    return files.select("path", F.explode(out).alias("x")).select("path", "x.*")


def components(files: DataFrame) -> DataFrame:
    """path, component: capitalised elements that scripts use, each once."""
    used = F.array_distinct(F.regexp_extract_all("content", F.lit(r"<([A-Z]\w+)[\s/>]"), 1))
    return files.where(F.col("language").isin(*SCRIPT)).select("path", F.explode(used).alias("component"))


def component_uses(files: DataFrame, exported: DataFrame, order: str = "ordinal") -> DataFrame:
    """src, dst, component: files that use a component, and the last file (by `order`) that exports its name; not themselves."""
    last = exported.join(files.select("path", order), "path").groupBy("name").agg(F.max_by("path", order).alias("dst"))
    used = components(files)
    return used.join(last, used["component"] == last["name"]).where("path <> dst").select(F.col("path").alias("src"), "dst", "component")


def specifiers(files: DataFrame) -> DataFrame:
    """path, source, names, is_default: what scripts and Python import from each source, the first import of a source."""
    script = r"(?m)^\s*import\s+(?:type\s+)?([^'\";]+?)\s+from\s+['\"]([^'\"]+)['\"]"
    clean = lambda names: F.filter(F.transform(F.split(names, ","), lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, r"[{}()]|\btype\s", ""), r"\s+as\s+\w+|\s+", " "))), lambda n: n != "")
    js = F.transform(F.regexp_extract_all("content", F.lit(script), 0), lambda m: F.struct(F.regexp_extract(m, script, 2).alias("source"), clean(F.regexp_extract(m, script, 1)).alias("names"), F.regexp_extract(m, script, 1).rlike(r"^[A-Za-z_$]").alias("is_default")))
    frm = r"(?m)^from\s+([\w.]+)\s+import\s+([^\n#]+)"
    plain = r"(?m)^import\s+([\w.]+(?:\s*,\s*[\w.]+)*)"
    py = F.transform(F.regexp_extract_all("content", F.lit(frm), 0), lambda m: F.struct(F.regexp_extract(m, frm, 1).alias("source"), clean(F.regexp_extract(m, frm, 2)).alias("names"), F.lit(False).alias("is_default")))
    mods = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(plain), 1), lambda m: F.split(m, r"\s*,\s*")))
    py = F.concat(py, F.transform(mods, lambda m: F.struct(m.alias("source"), F.array(F.element_at(F.split(m, r"\."), -1)).alias("names"), F.lit(False).alias("is_default"))))
    found = F.when(F.col("language").isin(*SCRIPT), js).when(F.col("language") == "python", py)
    return files.select("path", found.alias("found")).select("path", F.explode(first_of_each(F.col("found"), "source")).alias("x")).select("path", "x.*")


#: Fixed values, in order: framework, packages, paths.
FRAMEWORKS: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("Next.js", ("next",), r"app/.*/page\.(?:tsx?|jsx?)$|^next\.config\.(?:mjs|js|ts)$"),
    ("Nuxt", ("nuxt",), r"^nuxt\.config\.(?:ts|js)$"),
    ("SvelteKit", ("@sveltejs/kit",), r"^svelte\.config\.js$"),
    ("Vue", ("vue",), ""),
    ("Svelte", ("svelte",), ""),
    ("React", ("react",), ""),
    ("Express", ("express",), ""),
    ("Fastify", ("fastify",), ""),
    ("Django", (), r"manage\.py$|settings\.py$|django"),
    ("Flask", ("flask",), ""),
    ("FastAPI", ("fastapi",), ""),
    ("Go", (), r"main\.go$"),
    ("Rust/Cargo", (), r"^Cargo\.toml$"),
    ("Laravel", (), r"^artisan$|laravel"),
)


def framework(paths: DataFrame, packages: DataFrame, by: list[str]) -> DataFrame:
    """by..., framework: the first of FRAMEWORKS that a path or an external package (pkg) shows; null if none."""
    test = lambda name, pkgs, pattern: (F.col("pkg").isin(*pkgs) if pkgs else F.lit(False)) | (F.col("path").rlike(pattern) if pattern else F.lit(False))
    rank = F.lit(None).cast("int")
    for k, f in reversed(list(enumerate(FRAMEWORKS))):
        rank = F.when(F.coalesce(test(*f), F.lit(False)), k).otherwise(rank)
    both = paths.select(*by, "path", F.lit(None).cast("string").alias("pkg")).unionByName(packages.select(*by, F.lit(None).cast("string").alias("path"), "pkg"))
    return both.select(*by, rank.alias("rank")).groupBy(*by).agg(F.min("rank").alias("rank")).select(*by, F.get(F.array(*(F.lit(f[0]) for f in FRAMEWORKS)), F.col("rank")).alias("framework"))


SIGNATURE = r"(?m)^[ \t]*(?:export\s+(?:default\s+)?)?(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:function\*?|def|func|fn)\s+(?:\([^)\n]*\)\s*)?\w+\s*(?:<[^>\n]*>)?\([^)\n]*\)(?:[ \t]*(?:->|:)[ \t]*[^{=:\n]+)?"


def signatures(content: Column, limit: int = 20, width: int = 100) -> Column:
    """Declarations of functions in a text, at most `limit` of at most `width` characters."""
    return F.slice(F.transform(F.regexp_extract_all(content, F.lit(SIGNATURE), 0), lambda s: F.substring(F.rtrim(F.regexp_replace(F.trim(s), r"[:\s]+$", "")), 1, width)), 1, limit)


def capped(items: Column, limit: int) -> Column:
    """An array's first items, with a note of how many more there are."""
    return F.when(F.size(items) > limit, F.concat(F.slice(items, 1, limit), F.array(F.concat(F.lit("...("), (F.size(items) - limit).cast("string"), F.lit(" more)"))))).otherwise(items)


def structural_index(files: DataFrame, max_exports: int = 50, max_imports: int = 15) -> DataFrame:
    """path, language, line_count, exports, imports, signatures of each file, with limits for each list."""
    names = exports(files).groupBy("path").agg(F.sort_array(F.collect_list("name")).alias("exports"))
    sources = specifiers(files).groupBy("path").agg(F.slice(F.sort_array(F.collect_list("source")), 1, max_imports).alias("imports"))
    base = files.select("path", "language", line_count(F.col("content")).alias("line_count"), signatures(F.col("content")).alias("signatures"))
    return base.join(names, "path", "left").join(sources, "path", "left").withColumn("exports", capped(F.coalesce("exports", F.array().cast("array<string>")), max_exports)).withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))


def trimmed(index: DataFrame, budget: int) -> DataFrame:
    """A structural index within `budget` characters of JSON: signatures go first, then imports, then exports, of the files
    with the fewest exports first, until the rest fits. Each field's savings are running sums in that order."""
    fields = ("signatures", "imports", "exports")
    sized = index.withColumn("n_exports", F.size("exports"))
    size = lambda c: F.length(F.to_json(F.col(c)))
    need = sized.agg(F.sum(F.length(F.to_json(F.struct(*index.columns)))).alias("total")).first()[0] or 0
    over = need - budget
    steps = sized.select("path", "n_exports", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), size(c).alias("gain"), F.size(c).alias("items")) for k, c in enumerate(fields)))).alias("s")).where("s.items > 0")
    # Totals by field and count of exports first, so that only one such group is in a window's order at a time.
    w = Window.partitionBy("s.k").orderBy("n_exports", "path").rowsBetween(Window.unboundedPreceding, -1)
    totals = {r.k: r.gain for r in steps.groupBy("s.k").agg(F.sum("s.gain").alias("gain")).collect()}  # three rows
    before = F.lit(0)
    for k in range(3):
        before = F.when(F.col("s.k") == k, sum(totals.get(j, 0) for j in range(k))).otherwise(before)
    gone = steps.withColumn("saved", before + F.coalesce(F.sum("s.gain").over(w), F.lit(0))).where(F.col("saved") < over)
    gone = gone.groupBy("path").agg(F.collect_set("s.k").alias("gone"))
    out = index.join(gone, "path", "left")
    for k, c in enumerate(fields):
        out = out.withColumn(c, F.when(F.array_contains("gone", F.lit(k)), None).otherwise(F.col(c)))
    return out.select(*index.columns)


def file_routes(paths: DataFrame) -> DataFrame:
    """path, route, kind: pages and handlers that file-based routers serve. (group) and @slot folders don't show; [id] is :id."""
    app = r"(?:^|/)app/(.*?)/?(page|route)\.(?:tsx?|jsx?)$"
    pages = r"(?:^|/)pages/(.+)\.(?:vue|tsx?|jsx?)$"
    p = F.col("path")
    raw = F.when(p.rlike(app), F.regexp_extract(p, app, 1)).when(p.rlike(pages) & ~p.rlike(r"/_\w+\.\w+$"), F.regexp_replace(F.regexp_extract(p, pages, 1), r"(?:^|/)index$", ""))
    shown = F.array_join(F.filter(F.split(raw, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$|^@")), "/")
    route = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(shown, r"\[\[?\.\.\.(\w+)\]?\]", ":$1*"), r"\[(\w+)\]", ":$1"))
    kind = F.when(F.regexp_extract(p, app, 2) == "route", "api").when(p.rlike(r"(?:^|/)pages/api/"), "api").otherwise("page")
    return paths.select("path", route.alias("route"), kind.alias("kind")).where("route is not null")


def symbol_tree(found: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols (path, line_no, kind, name, indent) with end_line and parent: a symbol lies in the nearest earlier class with less
    indentation, and ends before the next symbol that is indented no deeper, or with its file."""
    rows = found.join(files.select("path", line_count(F.col("content")).alias("lines")), "path")
    listed = rows.groupBy("path", "lines").agg(F.sort_array(F.collect_list(F.struct("line_no", "indent", "kind", "name"))).alias("all"))

    def place(x: Column) -> Column:
        later = F.filter("all", lambda y: (y["line_no"] > x["line_no"]) & (y["indent"] <= x["indent"]))
        outer = F.filter("all", lambda y: (y["line_no"] < x["line_no"]) & (y["indent"] < x["indent"]) & (y["kind"] == "class"))
        return F.struct(x["line_no"].alias("line_no"), F.coalesce(F.get(later, F.lit(0))["line_no"] - 1, F.col("lines")).alias("end_line"), x["kind"].alias("kind"), x["name"].alias("name"), F.try_element_at(outer, F.lit(-1))["name"].alias("parent"))

    return listed.select("path", F.explode(F.transform("all", place)).alias("x")).select("path", "x.*")


def declared(files: DataFrame) -> DataFrame:
    """path, line_no, kind, name, indent: functions, methods and classes of scripts and Python."""
    patterns = (("class", r"^(\s*)(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("function", r"^(\s*)(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|def)\s+(\w+)"), ("method", r"^(\s+)(?:(?:public|private|protected|static|async|get|set)\s+)*(\w+)\s*\([^)]*\)\s*(?::\s*[^{=]+)?\{\s*$"))
    t = F.col("text")
    arm = F.coalesce(*(F.when(t.rlike(p) & ~F.regexp_extract(t, p, 2).isin("if", "for", "while", "switch", "catch", "return", "function"), F.struct(F.lit(k).alias("kind"), F.regexp_extract(t, p, 2).alias("name"), F.length(F.regexp_extract(t, p, 1)).alias("indent"))) for k, p in patterns))
    lines = files.select("path", F.posexplode(split_lines(F.col("content"))).alias("i", "text"))
    return lines.select("path", (F.col("i") + 1).alias("line_no"), arm.alias("s")).where("s is not null").select("path", "line_no", "s.*")


DOCUMENTED = r"(?s)/\*\*((?:[^*]|\*(?!/))*)\*/\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)(?:\s*:\s*([^{]+?))?\s*\{"


def typed_functions(files: DataFrame) -> DataFrame:
    """path, name, summary, params array<struct<name, type, optional>>, returns: script functions with a doc comment."""
    param = lambda p: F.struct(F.regexp_extract(p, r"^\s*(?:\.\.\.)?(\w+)", 1).alias("name"), F.trim(F.regexp_extract(p, r":\s*([^=]+)", 1)).alias("type"), (p.rlike(r"^\s*\w+\?") | p.contains("=")).alias("optional"))
    summary = lambda d: F.trim(F.regexp_replace(F.regexp_extract(F.regexp_replace(d, r"(?m)^\s*\* ?", ""), r"(?s)^\s*(.*?)\s*(?:@|$)", 1), r"\s+", " "))
    one = lambda m: F.struct(F.regexp_extract(m, DOCUMENTED, 2).alias("name"), summary(F.regexp_extract(m, DOCUMENTED, 1)).alias("summary"), F.transform(F.filter(F.split(F.regexp_extract(m, DOCUMENTED, 3), ","), lambda p: F.trim(p) != ""), param).alias("params"), F.trim(F.regexp_extract(m, DOCUMENTED, 4)).alias("returns"))
    return files.where(F.col("language").isin(*SCRIPT)).select("path", F.explode(F.transform(F.regexp_extract_all("content", F.lit(DOCUMENTED), 0), one)).alias("x")).select("path", "x.*")


def outline(files: DataFrame, limit: int = 20) -> DataFrame:
    """path, outline: a text of a file's imports, exports and signatures, at most `limit` of each."""
    index = structural_index(files, limit, limit)
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{title}: "), F.array_join(F.slice(c, 1, limit + 1), ", ")))
    return index.select("path", F.concat_ws("\n", F.concat(F.col("path"), F.lit(" ("), F.col("line_count").cast("string"), F.lit(" lines)")), part("imports", F.col("imports")), part("exports", F.col("exports")), part("functions", F.col("signatures"))).alias("outline"))


def primary_language(files: DataFrame, by: list[str], order: str = "ordinal") -> DataFrame:
    """by..., language, n: the language of most files, of equals the one seen first; unknown only where there is no other."""
    counts = files.where("language is not null and language <> 'unknown'").groupBy(*by, "language").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(*by).agg(F.max_by(F.struct("language", "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("x")) if by else counts.agg(F.max_by(F.struct("language", "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("x"))
    return best.select(*by, F.coalesce("x.language", F.lit("unknown")).alias("language"), "x.n")


# Languages of a scan, by extension.
SCANNED_LANGUAGES = {
    "JavaScript/TypeScript": "js jsx ts tsx mjs cjs",
    "Python": "py pyw",
    "Go": "go",
    "Rust": "rs",
    "Java": "java",
    "Kotlin": "kt kts",
    "C/C++": "c cpp cc cxx h hpp",
    "C#": "cs",
    "Ruby": "rb rake",
    "PHP": "php",
    "Shell": "sh bash zsh",
    "Swift": "swift",
    "Dart": "dart",
}


def scanned_language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for name, exts in SCANNED_LANGUAGES.items() for e in exts.split() for x in (e, name)))
    return F.try_element_at(table, extension(path))
