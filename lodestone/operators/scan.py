"""Rule scanner: line rules, context, caps, co-occurrence rules, scores and grades.

Rules are data. All rules of a scan are folded into one projection that gives an array of matches for each line, behind one
combined pattern that drops texts no rule can match; rules are never joined with lines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import ordinal, round_half_up, split_lines
from lodestone.operators.search import to_lines, whole_text

SEVERITIES = ("critical", "warning", "info")
CONFIDENCES = ("high", "medium", "low")
# Score parts by severity, confidence and category.
BASE = {"critical": 9.0, "warning": 5.0, "info": 2.0}
TRUST = {"high": 1.0, "medium": 0.8, "low": 0.5}
KIND = {"security": 1.0, "reliability": 0.5}
CAP = 15


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    severity: str
    category: str
    confidence: str = "medium"
    cwe: str = ""
    exclude: str = ""
    extensions: tuple[str, ...] = field(default=())
    #: Texts of which every match of the pattern holds one; they are looked for before the pattern is tried.
    needs: tuple[str, ...] = ()


def _map(of: Column, values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(of == k, v).otherwise(out)
    return out


def may_match(text: Column, rules: list[Rule]) -> Column:
    """A cheap test that holds wherever a rule matches: the texts that rules need, and one pattern of the rules without such."""
    out = F.lit(False)
    for t in dict.fromkeys(t for r in rules for t in r.needs):
        out = out | text.contains(t)
    rest = "|".join(f"(?:{r.pattern})" for r in rules if not r.needs)
    return out | text.rlike(rest) if rest else out


def scan_lines(files: DataFrame, rules: list[Rule], path: str = "path", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """path, line_no, text, keep..., rule_id, severity, category, confidence, cwe: one row for a rule and line at most. `keep` are
    columns of the files that stay with their findings, so they needn't be joined back."""
    hit = files.where(may_match(F.col(content), rules)) if all(r.needs or whole_text(r.pattern) for r in rules) else files
    lines = to_lines(hit, path, content, keep).where(may_match(F.col("text"), rules))

    def arm(r: Rule) -> Column:
        ok = F.col("text").rlike(r.pattern)
        for k, t in enumerate(reversed(r.needs)):
            has = F.col("text").contains(t) if k == 0 else has | F.col("text").contains(t)
        if r.needs:
            ok = has & ok
        if r.exclude:
            ok &= ~F.col("text").rlike(r.exclude)
        if r.extensions:
            ok &= F.regexp_extract(F.col("path").cast("string"), r"\.([A-Za-z0-9]+)$", 1).isin(*r.extensions)
        return F.when(ok, F.struct(*(F.lit(v).alias(k) for k, v in (("rule_id", r.id), ("severity", r.severity), ("category", r.category), ("confidence", r.confidence), ("cwe", r.cwe)))))

    return lines.withColumn("m", F.explode(F.array_compact(F.array(*map(arm, rules))))).select("path", "line_no", "text", *keep, "m.*")


def lower_confidence(issues: DataFrame, when: Column) -> DataFrame:
    """One step down the confidences where the condition holds."""
    step = F.element_at(F.array(*map(F.lit, CONFIDENCES)), F.least(ordinal(F.col("confidence"), CONFIDENCES) + 2, F.lit(3)))
    return issues.withColumn("confidence", F.when(when, step).otherwise(F.col("confidence")))


def near_line(files: DataFrame, flag: Callable[[Column], Column], before: int, after: int, path: str = "path", content: str = "content") -> DataFrame:
    """path, line_no, text, near: another line within the distance has the flag. Taken from each file's array of lines."""
    rows = files.select(F.col(path).alias("path"), split_lines(F.col(content)).alias("lines"))
    rows = rows.select("path", "lines", F.transform("lines", flag).alias("flags"))

    def near(i: Column) -> Column:
        out = F.lit(False)
        for d in (*range(-before, 0), *range(1, after + 1)):
            out = out | F.coalesce(F.get("flags", i + d), F.lit(False))
        return out

    each = F.transform("lines", lambda t, i: F.struct(t.alias("text"), near(i).alias("near")))
    return rows.select("path", F.posexplode(each).alias("i", "x")).select("path", (F.col("i") + 1).alias("line_no"), "x.text", "x.near")


def suppressed(files: DataFrame, same: str = "scan-ignore-line", following: str = "scan-ignore-next-line", path: str = "path", content: str = "content") -> DataFrame:
    """path, line_no, text, hidden: the mark `same` is on the line itself, or `following` on the one before."""
    rows = files.select(F.col(path).alias("path"), split_lines(F.col(content)).alias("lines"))
    each = F.transform("lines", lambda t, i: F.struct(t.alias("text"), (t.contains(same) | F.coalesce(F.get("lines", i - 1).contains(following), F.lit(False))).alias("hidden")))
    return rows.select("path", F.posexplode(each).alias("i", "x")).select("path", (F.col("i") + 1).alias("line_no"), "x.text", "x.hidden")


def cap_rules(issues: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """The first `cap` issues of each rule by path and line, and rule_id, overflow of the others. Spark limits each group
    before it shuffles, so a frequent rule isn't gathered whole."""
    rn = F.row_number().over(Window.partitionBy("rule_id").orderBy("path", "line_no"))
    return issues.withColumn("rn", rn).where(F.col("rn") <= cap).drop("rn"), issues.groupBy("rule_id").agg((F.count("*") - cap).alias("overflow")).where("overflow > 0")


def first_by_id(issues: DataFrame, key: list[str], order: list) -> DataFrame:
    """One issue for each key, the first in order."""
    return issues.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def together(lines: DataFrame, required: dict[str, str], forbidden: str = "", distance: int | None = None) -> DataFrame:
    """path, first lines of each required pattern: files where all are found and the forbidden one isn't; with a distance,
    only if the first lines lie that close."""
    aggs = [F.min(F.when(F.col("text").rlike(p), F.col("line_no"))).alias(k) for k, p in required.items()]
    aggs.append(F.max(F.col("text").rlike(forbidden) if forbidden else F.lit(False)).alias("_no"))
    out = lines.groupBy("path").agg(*aggs).where("not _no").drop("_no").dropna()
    if distance is not None:
        out = out.where(F.greatest(*required) - F.least(*required) <= distance)
    return out


def score(issues: DataFrame) -> DataFrame:
    """risk_score: base of the severity times trust, with parts for category and cwe, clamped to 0..10, one decimal."""
    raw = _map(F.col("severity"), BASE, 2.0) * _map(F.col("confidence"), TRUST, 0.8) + _map(F.col("category"), KIND, 0.0) + F.when(F.col("cwe") != "", 0.5).otherwise(0.0)
    return issues.withColumn("risk_score", round_half_up(F.greatest(F.least(raw, F.lit(10.0)), F.lit(0.0)), 1))


def band(score_: Column) -> Column:
    return F.when(score_ >= 8, "critical").when(score_ >= 5, "high").when(score_ >= 3, "medium").otherwise("low")


def summary(issues: DataFrame, by: list[str]) -> DataFrame:
    c = lambda cond: F.count(F.when(cond, 1))
    return issues.groupBy(*by).agg(
        F.count("*").alias("total"), *(c(F.col("severity") == s).alias(s) for s in SEVERITIES), *(c(F.col("category") == s).alias(s) for s in ("security", "reliability", "style")), c((F.col("severity") == "warning") & (F.col("category") == "security")).alias("security_warnings")
    )


def letter(x: Column) -> Column:
    return F.when(x >= 90, "A").when(x >= 75, "B").when(x >= 60, "C").when(x >= 40, "D").otherwise("F")


def grades(summaries: DataFrame, sloc: Column) -> DataFrame:
    """health score and grade, quality grade by issues per 1000 lines (in thousandths, as an integer)."""
    penalty = 100 - 30 * F.col("critical") - 8 * F.col("warning") - 2 * F.col("info")
    points = F.greatest(F.lit(0), F.least(F.lit(100), penalty))
    points = F.when(F.col("critical") > 0, F.least(points, F.lit(35))).otherwise(points)
    points = F.when(F.col("security_warnings") > 0, F.least(points, F.lit(89))).otherwise(points)
    per = F.floor(F.col("total") * 1_000_000 / F.greatest(sloc, F.lit(1))).cast("long")
    quality = F.when(per < 5000, "A").when(per < 15000, "B").when(per < 30000, "C").when(per < 50000, "D").otherwise("F")
    return summaries.withColumn("points", points.cast("long")).withColumn("grade", letter(F.col("points"))).withColumn("issues_per_kloc_milli", per).withColumn("quality", quality)


def merge(base: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Union of two scans, base first."""
    return first_by_id(base.withColumn("_from", F.lit(0)).unionByName(other.withColumn("_from", F.lit(1))), key, ["_from"]).drop("_from")


def coverage(items: DataFrame, rules: DataFrame, issues: DataFrame) -> DataFrame:
    """items (item, cwe), rules (rule_id, cwe), issues (cwe): rules and issues of each item and its status."""
    with_rules = items.join(rules, "cwe", "left").groupBy("item").agg(F.countDistinct("rule_id").alias("n_rules"))
    with_issues = items.join(issues.groupBy("cwe").agg(F.count("*").alias("n")), "cwe", "left").groupBy("item").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_issues"))
    status = F.when(F.col("n_rules") == 0, "no-coverage").when(F.col("n_issues") > 0, "fail").when(F.col("n_rules") <= 1, "warn").otherwise("pass")
    return with_rules.join(with_issues, "item").withColumn("status", status)


def accuracy(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """rule_id, true positives, false positives, missed: multisets of (rule_id, *key) compared one to one."""
    cols = ["rule_id", *key]
    rn = F.row_number().over(Window.partitionBy(*cols).orderBy(F.lit(0)))
    e, a = expected.withColumn("k", rn).withColumn("e", F.lit(1)), actual.withColumn("k", rn).withColumn("a", F.lit(1))
    c = lambda x: F.count(F.when(x, 1))
    return e.join(a, [*cols, "k"], "full").groupBy("rule_id").agg(c(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("tp"), c(F.col("e").isNull()).alias("fp"), c(F.col("a").isNull()).alias("missed"))


def project_score(issues: DataFrame, by: list[str]) -> DataFrame:
    """by..., project_score: risk scores weighted by themselves, one decimal; 0 without a score."""
    s = F.col("risk_score")
    return issues.groupBy(*by).agg(F.coalesce(round_half_up(F.sum(s * s) / F.nullif(F.sum(s), F.lit(0.0)), 1), F.lit(0.0)).alias("project_score"))


def security_grades(summaries: DataFrame) -> DataFrame:
    """Summaries with security_points and security_grade, by the security findings alone (security_critical, security_warnings,
    security_info)."""
    points = F.greatest(F.lit(0), F.least(F.lit(100), 100 - 30 * F.col("security_critical") - 8 * F.col("security_warnings") - 2 * F.col("security_info")))
    points = F.when(F.col("security_critical") > 0, F.least(points, F.lit(35))).otherwise(points)
    points = F.when(F.col("security_warnings") > 0, F.least(points, F.lit(89))).otherwise(points)
    return summaries.withColumn("security_points", points.cast("long")).withColumn("security_grade", letter(F.col("security_points")))


def accuracy_rates(found: DataFrame, rules: DataFrame) -> DataFrame:
    """accuracy with category (of rules: rule_id, category), fp_rate (false positives of all that fired, 3 decimals)."""
    fired = F.col("tp") + F.col("fp")
    return found.join(rules, "rule_id", "left").withColumn("fp_rate", F.when(fired > 0, round_half_up(F.col("fp") / fired, 3)).otherwise(0.0))


def shown(issues: DataFrame, severity: str = "", category: str = "", hide_info: bool = False, hide_low: bool = False) -> DataFrame:
    """Issues that pass a list's filters."""
    out = issues
    for column, value in (("severity", severity), ("category", category)):
        out = out.where(F.col(column) == value) if value else out
    out = out.where("severity <> 'info'") if hide_info else out
    return out.where("confidence <> 'low'") if hide_low else out


def merged_overflow(base: DataFrame, other: DataFrame) -> DataFrame:
    """rule_id, overflow summed over two scans."""
    return base.unionByName(other).groupBy("rule_id").agg(F.sum("overflow").cast("long").alias("overflow"))


def merged_size(base_issues: DataFrame, base_per_kloc: DataFrame, files: DataFrame) -> DataFrame:
    """One row: source lines estimated for a merged scan, from the base's issues and density, else 100 a file."""
    n = base_issues.agg(F.count("*").alias("n")).crossJoin(base_per_kloc).crossJoin(files)  # one row each
    return n.select(F.when(F.col("per_kloc") > 0, F.round(F.col("n") / F.col("per_kloc") * 1000)).otherwise(F.col("files") * 100).cast("long").alias("sloc"))


def rules_evaluated(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row: how many rules apply to some file by its extension."""
    from lodestone.functions.text import extension

    flags = [(F.lit(True) if not r.extensions else F.col("ext").isin(*r.extensions)) for r in rules]
    any_ = files.select(extension(F.col("path")).alias("ext")).distinct().agg(*(F.max(f).cast("int").alias(f"r{k}") for k, f in enumerate(flags)))
    return any_.select(sum((F.coalesce(F.col(f"r{k}"), F.lit(0)) for k in range(len(rules))), F.lit(0)).cast("long").alias("rules"))
