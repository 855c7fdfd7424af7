"""Roll-ups and report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import line_count


def breakdown(files: DataFrame, by: Column, content: str = "content") -> DataFrame:
    """key, files, lines, basis points of all lines (an integer)."""
    out = files.groupBy(by.alias("key")).agg(F.count("*").alias("files"), F.sum(line_count(F.coalesce(F.col(content), F.lit("")))).cast("long").alias("lines"))
    total = out.agg(F.sum("lines").alias("all"))
    return out.join(F.broadcast(total)).select("key", "files", "lines", F.floor(F.col("lines") * 10000 / F.col("all")).cast("long").alias("bp"))


def treemap(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """prefix, depth, size: sums over every path prefix (folders and files), those of size 0 left out."""
    parts = F.split(F.col(path), "/")
    each = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("prefix"), k.alias("depth")))).alias("p"), F.col(size).alias("size"))
    return each.groupBy("p.prefix", "p.depth").agg(F.sum("size").alias("size")).where("size > 0")


def top_with_rest(counts: DataFrame, key: str, n: str, k: int) -> DataFrame:
    """The k largest, and one row `+N more` for what is left."""
    top = counts.orderBy(F.desc(n), key).limit(k)
    rest = counts.join(top.select(key), key, "left_anti").agg(F.count("*").alias("c"), F.sum(n).alias(n)).where("c > 0").select(F.concat(F.lit("+"), F.col("c").cast("string"), F.lit(" more")).alias(key), n)
    return top.select(key, n).unionByName(rest)


def mermaid(edges: DataFrame, limit: int = 200) -> DataFrame:
    """One row, `text`: a flowchart of the first `limit` edges (src, dst, n)."""
    ident = lambda c: F.regexp_replace(c.cast("string"), "[^A-Za-z0-9]", "_")
    rows = edges.orderBy(F.desc("n"), "src", "dst").limit(limit).select(F.struct(-F.col("n"), "src", "dst", F.concat(F.lit("  "), ident(F.col("src")), F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "), ident(F.col("dst"))).alias("line")).alias("r"))
    return rows.agg(F.concat_ws("\n", F.lit("flowchart LR"), F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"])).alias("text"))


def keep_recent(rows: DataFrame, key: str, order: str, text: str, keep: int, chars: int) -> DataFrame:
    """The last `keep` rows of a key as they are, older ones cut to `chars` characters."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("rn", rn).withColumn(text, F.when(F.col("rn") > keep, F.substring(F.col(text), 1, chars)).otherwise(F.col(text))).withColumn("compacted", F.col("rn") > keep).drop("rn")


# Sinks: reports and diagrams as one text for a group -----------------------------------------------------------------


def text_of(lines: DataFrame, by: list[str], order: list[str], line: str = "line") -> DataFrame:
    """by..., text: the lines of a group in order, joined. Reports hold a bounded number of lines for a group."""
    return lines.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*(c for c in order if c != line), line))).alias("x")).select(*by, F.array_join(F.transform("x", lambda e: e[line]), "\n").alias("text"))


def _lines(df: DataFrame, by: list[str], section: int, order, line) -> DataFrame:
    return df.select(*by, F.lit(section).alias("section"), order.cast("long").alias("place"), line.alias("line"))


def issues_markdown(findings: DataFrame, by: list[str], most: int = 50) -> DataFrame:
    """by..., text: findings by severity as a Markdown report, the first `most` of each severity, with how many there are."""
    from lodestone.functions.text import ordinal
    from lodestone.operators.scan import SEVERITIES

    rank = ordinal(F.col("severity"), SEVERITIES)
    w = Window.partitionBy(*by, "severity").orderBy("path", "line_no", "rule_id")
    rows = findings.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    heads = findings.groupBy(*by, "severity").agg(F.count("*").alias("n"))
    title = _lines(findings.select(*by).distinct(), by, 0, F.lit(0), F.lit("## Issues"))
    head = _lines(heads, by, 1, rank * 1_000_000, F.concat(F.lit("### "), F.initcap("severity"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    body = _lines(rows, by, 1, rank * 1_000_000 + F.col("rn"), F.concat(F.lit("- `"), F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit("` "), F.col("rule_id")))
    return text_of(title.unionByName(head).unionByName(body), by, ["section", "place"])


def repository_markdown(repositories: DataFrame, totals: DataFrame, findings: DataFrame) -> DataFrame:
    """full_name, text: a repository (full_name, url, language, stars), its totals (full_name, files, lines, framework), its issues."""
    by = ["full_name"]
    c = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("None"))
    head = repositories.join(totals, by, "left").select(*by, F.posexplode(F.array(F.concat(F.lit("# "), c("full_name")), F.concat(F.lit("| URL | "), c("url"), F.lit(" |")), F.concat(F.lit("| Language | "), c("language"), F.lit(" |")), F.concat(F.lit("| Stars | "), c("stars"), F.lit(" |")), F.concat(F.lit("- Files: "), c("files")), F.concat(F.lit("- Lines: "), c("lines")), F.concat(F.lit("- Framework: "), c("framework")))).alias("place", "line"))
    issues = issues_markdown(findings, by)
    return head.select(*by, F.lit(0).alias("section"), F.col("place").cast("long").alias("place"), "line").transform(lambda d: text_of(d, by, ["section", "place"])).join(issues.withColumnRenamed("text", "issues"), by, "left").select(*by, F.concat_ws("\n\n", "text", "issues").alias("text"))


def summary_snippet(summaries: DataFrame, by: list[str]) -> DataFrame:
    """by..., text: one line for a chat: grade, issues by severity."""
    n = lambda c: F.col(c).cast("string")
    return summaries.select(*by, F.concat(F.lit("**"), F.col("grade"), F.lit("** "), n("total"), F.lit(" issues: "), n("critical"), F.lit(" critical, "), n("warning"), F.lit(" warnings, "), n("info"), F.lit(" notes")).alias("text"))


def as_json(df: DataFrame, by: list[str]) -> DataFrame:
    """by..., json: the other columns as one JSON object (nested arrays and maps become arrays and objects)."""
    return df.select(*by, F.to_json(F.struct(*(c for c in df.columns if c not in by))).alias("json"))


def compliance_json(coverage: DataFrame) -> DataFrame:
    """One row: the items of a compliance report in order, and the share that is covered in percent (one decimal)."""
    from lodestone.functions.text import round_half_up

    items = F.transform(F.sort_array(F.collect_list(F.struct("item", "n_rules", "n_issues", "status"))), lambda x: x)
    share = round_half_up(F.count(F.when(F.col("status") != "no-coverage", 1)) * 100.0 / F.count("*"), 1)
    return coverage.agg(F.to_json(F.struct(share.alias("covered"), items.alias("items"))).alias("json"))


def flow(nodes: DataFrame, edges: DataFrame, by: list[str], direction: str = "TD") -> DataFrame:
    """by..., text: a flowchart of nodes (by..., node, label, style) and edges (by..., src, dst, label); ids are made of names."""
    from lodestone.functions.text import node_id

    start = _lines(nodes.select(*by).distinct(), by, 0, F.lit(0), F.lit(f"flowchart {direction}"))
    shown = F.concat(F.lit("  "), node_id(F.col("node")), F.lit('["'), F.replace("label", F.lit('"'), F.lit("'")), F.lit('"]'), F.when(F.col("style").isNotNull(), F.concat(F.lit(":::"), F.col("style"))).otherwise(""))
    arrow = F.concat(F.lit("  "), node_id(F.col("src")), F.lit(" -->"), F.when(F.col("label").isNotNull(), F.concat(F.lit("|"), F.col("label"), F.lit("|"))).otherwise(""), F.lit(" "), node_id(F.col("dst")))
    body = _lines(nodes, by, 1, F.lit(0), shown).unionByName(_lines(edges, by, 2, F.lit(0), arrow)).unionByName(start)
    return text_of(body, by, ["section", "place", "line"])


def class_diagram(types: DataFrame, by: list[str], most: int = 8) -> DataFrame:
    """by..., text: a class diagram of types (name, kind, properties, extends), `most` properties of each."""
    start = _lines(types.select(*by).distinct(), by, 0, F.lit(0), F.lit("classDiagram"))
    props = F.array_join(F.transform(F.slice("properties", 1, most), lambda p: F.concat(F.lit("    "), F.regexp_replace(p, r"[{}<>\"]", ""))), "\n")
    body = _lines(types, by, 1, F.lit(0), F.concat(F.lit("  class "), F.col("name"), F.lit(" {\n    <<"), F.col("kind"), F.lit(">>\n"), props, F.lit("\n  }")))
    links = _lines(types.select(*by, "name", F.explode("extends").alias("base")), by, 2, F.lit(0), F.concat(F.lit("  "), F.col("base"), F.lit(" <|-- "), F.col("name")))
    return text_of(start.unionByName(body).unionByName(links), by, ["section", "place", "line"])


def pie_chart(counts: DataFrame, by: list[str], title: str) -> DataFrame:
    """by..., text: a pie of (by..., key, n), largest first."""
    start = _lines(counts.select(*by).distinct(), by, 0, F.lit(0), F.lit(f"pie title {title}"))
    return text_of(start.unionByName(_lines(counts, by, 1, -F.col("n"), F.concat(F.lit('  "'), F.col("key"), F.lit('" : '), F.col("n").cast("string")))), by, ["section", "place", "line"])


#: Fixed table: categories of external packages, in order; a package is in the first that has it, else a beginning of it.
CATEGORIES: dict[str, str] = {
    "UI Framework": "react react-dom next vue svelte angular solid-js preact nuxt",
    "Styling": "tailwindcss styled-components @emotion sass postcss clsx class-variance-authority tailwind-merge",
    "UI Components": "@radix-ui @headlessui @shadcn lucide-react @heroicons framer-motion recharts mermaid",
    "State & Data": "zustand redux @tanstack swr axios graphql @apollo immer jotai",
    "Auth & Backend": "@supabase @prisma drizzle-orm @auth next-auth firebase mongoose pg bcrypt jsonwebtoken",
    "AI & ML": "ai @ai-sdk openai @anthropic-ai langchain",
    "Validation": "zod yup joi ajv valibot",
    "Tooling": "typescript eslint prettier vitest jest @testing-library vite esbuild",
}


def category(pkg, table: dict[str, str] = CATEGORIES):
    """The category of a package: by its name, else by how it begins, else Other."""
    pairs = [(p, name) for name, pkgs in table.items() for p in pkgs.split()]
    begins = F.lit("Other")
    for p, name in reversed(pairs):
        begins = F.when(pkg.startswith(p), name).otherwise(begins)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs for x in kv)), pkg), begins)


def packages_by_category(packages: DataFrame, most: int = 15) -> DataFrame:
    """(pkg, importers) -> category, pkg, importers, place: `most` of each category, and one row with how many more there are."""
    rows = packages.withColumn("category", category(F.col("pkg")))
    rn = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("importers"), "pkg"))
    ranked = rows.withColumn("place", rn)
    rest = ranked.where(F.col("place") > most).groupBy("category").agg(F.count("*").alias("n"), F.sum("importers").alias("importers"))
    more = rest.select("category", F.concat(F.lit("+"), F.col("n").cast("string"), F.lit(" more")).alias("pkg"), "importers", F.lit(most + 1).alias("place"))
    return ranked.where(F.col("place") <= most).select("category", "pkg", "importers", "place").unionByName(more)


def folders(files: DataFrame, most: int = 12) -> DataFrame:
    """folder, files, lines, pct: by first folder; by the first two where fewer than three first folders have more than one file
    and there are more than ten files. (root) shows only if it is alone."""
    from lodestone.functions.text import round_half_up

    rows = files.select(F.split("path", "/").alias("parts"), "line_count")
    at = lambda d: F.when(F.size("parts") > d, F.array_join(F.slice("parts", 1, d), "/")).otherwise("(root)")
    counts = lambda d: rows.groupBy(at(d).alias("folder")).agg(F.count("*").alias("files"), F.sum("line_count").cast("long").alias("lines")).withColumn("depth", F.lit(d))
    one = counts(1)
    how = one.agg(F.when((F.count(F.when(F.col("files") > 1, 1)) < 3) & (F.sum("files") > 10), 2).otherwise(1).alias("depth"), F.sum("lines").alias("all"))
    chosen = one.unionByName(counts(2)).join(F.broadcast(how), "depth")
    alone = chosen.agg(F.count("*").alias("n"))
    out = chosen.crossJoin(F.broadcast(alone)).where((F.col("folder") != "(root)") | (F.col("n") == 1))  # one row
    return out.select("folder", "files", "lines", F.when(F.col("all") > 0, round_half_up(F.col("lines") * 100.0 / F.col("all"), 1)).otherwise(0.0).alias("pct")).orderBy(F.desc("lines"), "folder").limit(most)
