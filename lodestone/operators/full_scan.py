"""The whole scan of a repository: every phase's findings as one table, the first of each id, capped, scored and graded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import line_count, vector
from lodestone.operators import context, scan
from lodestone.operators.context import Composite
from lodestone.operators.scan import CAP, Rule

# Fixed table: CWE by kind of taint.
TAINT_CWE = {"sql": "CWE-89", "command": "CWE-78", "xss": "CWE-79", "path": "CWE-22", "redirect": "CWE-601", "ssrf": "CWE-918", "eval": "CWE-94"}
COLUMNS = ("phase", "id", "path", "line_no", "rule_id", "severity", "category", "confidence", "cwe")


def full_scan(files: DataFrame, line_rules: list[Rule], syntax_rules: list[Rule], composites: list[Composite], cap: int = CAP) -> DataFrame:
    """phase, id, path, line_no, rule_id, severity, category, confidence, cwe, risk_score, vector.

    Phases in order: lines (0), joined lines (1), syntax (2), taint (3), file rules (4). Of one id the first phase stays; a rule
    has `cap` findings of lines at most, and `cap` of syntax in each file; where `eval` is found by line it isn't by syntax, and
    an empty catch found by syntax isn't by line.
    """
    phase = lambda k, df: df.withColumn("phase", F.lit(k)).select(*COLUMNS)
    capped = lambda df, *by: df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy("path", "line_no"))).where(F.col("_rn") <= cap).drop("_rn")
    cwe = F.create_map(*(F.lit(x) for kv in TAINT_CWE.items() for x in kv))
    flows = context.taint(files).select(
        F.concat_ws("-", "rule_id", "path", "line_no").alias("id"), "path", "line_no", "rule_id", F.when(F.col("kind").isin("sql", "command", "eval"), "critical").otherwise("warning").alias("severity"), F.lit("security").alias("category"), F.lit("high").alias("confidence"), F.try_element_at(cwe, F.col("kind")).alias("cwe")
    )
    parts = [
        phase(0, capped(context.findings(files, line_rules), "rule_id")),
        phase(1, context.findings(files, line_rules, over_lines=True)),
        phase(2, capped(context.findings(files, syntax_rules, over_lines=True, only=None), "rule_id", "path")),
        phase(3, flows),
        phase(4, context.composites(files, composites)),
    ]
    both = scan.first_by_id(reduce(DataFrame.unionByName, parts), ["id"], ["phase"])
    both = context.prefer(context.prefer(both, "eval-usage", "ast-eval-usage"), "ast-empty-catch", "empty-catch")
    scored = scan.score(both.withColumn("cwe", F.coalesce("cwe", F.lit(""))))
    return scored.withColumn("vector", vector(F.col("severity"), F.col("confidence"), F.col("category"), F.col("cwe"))).select(*COLUMNS, "risk_score", "vector")


def graded(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row: totals, points and grades of a scan, the project's risk, and how many files and lines were scanned."""
    by = findings.withColumn("project", F.lit(1))
    security = lambda s: F.count(F.when((F.col("severity") == s) & (F.col("category") == "security"), 1))
    extra = by.groupBy("project").agg(security("critical").alias("security_critical"), security("info").alias("security_info"))
    size = context.scanned(files).agg(F.sum(line_count(F.col("content"))).cast("long").alias("sloc"), F.count("*").alias("files")).withColumn("project", F.lit(1))
    sums = size.join(scan.summary(by, ["project"]), "project", "left").join(extra, "project", "left").join(scan.project_score(by, ["project"]), "project", "left").na.fill(0)
    out = scan.security_grades(scan.grades(sums, F.col("sloc")))
    return out.select("files", "sloc", "total", "critical", "warning", "info", "points", "grade", "security_grade", "quality", "project_score")


def rescan(base: DataFrame, files: DataFrame, changed: DataFrame, scanner) -> DataFrame:
    """Findings after some files changed (path; removed ones too): those of all other files, and a scan of the changed ones."""
    fresh = scanner(files.join(changed.select("path").distinct(), "path", "left_semi"))
    return base.join(changed.select("path").distinct(), "path", "left_anti").unionByName(fresh)
