"""Manifests, workflows and known vulnerabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import ordinal, parent_path
from lodestone.operators.search import to_lines

LEVELS = ("critical", "high", "medium", "moderate", "low")
INSTALL_SCRIPT = r"(?:curl|wget)\b[^|]*\|\s*(?:ba)?sh|\beval\b|base64\s+-d|https?://\d+\.\d+\.\d+\.\d+"


# Fixed table: packages that are deprecated, and the severity of using one.
DEPRECATED = {"request": "info", "moment": "info", "node-uuid": "info", "vm2": "warning", "node-serialize": "warning"}
LOCKFILES = r"(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb?)$"
MANIFEST = "name string, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, overrides string, resolutions string, publishConfig struct<registry:string>"


def manifest_issues(manifests: DataFrame, paths: DataFrame) -> DataFrame:
    """(repo, path, content of package.json), (repo, path) of all files -> repo, path, rule_id, severity, detail. A manifest
    needs a lockfile in its own folder; malformed manifests have no findings."""
    m = manifests.select("repo", "path", parent_path(F.col("path")).alias("folder"), F.from_json("content", MANIFEST).alias("m"), F.get_json_object("content", "$").alias("whole")).where("whole is not null")
    deps = m.select("repo", "path", F.explode(F.map_entries("m.dependencies")).alias("d")).unionAll(m.select("repo", "path", F.explode(F.map_entries("m.devDependencies"))))
    named = lambda df, rule, severity, detail: df.select("repo", "path", F.lit(rule).alias("rule_id"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), detail.alias("detail"))
    scripts = m.select("repo", "path", F.explode("m.scripts").alias("name", "cmd"))
    hooks = scripts.where(F.col("name").isin("preinstall", "install", "postinstall", "prepare") & F.col("cmd").rlike(INSTALL_SCRIPT))
    lock = paths.where(F.col("path").rlike(LOCKFILES)).select("repo", parent_path(F.col("path")).alias("folder")).distinct()
    old = F.create_map(*(F.lit(x) for kv in DEPRECATED.items() for x in kv))
    parts = (
        named(hooks, "suspicious-script", "warning", F.col("name")),
        named(deps.where(F.trim("d.value").isin("*", "latest", "x", "")), "star-version", "warning", F.col("d.key")),
        named(deps.where(F.col("d.value").rlike(r"^(?:git\+|git:|github:|https?://.*\.git)")), "git-dependency", "info", F.col("d.key")),
        named(deps.where(F.col("d.value").startswith("http:")), "http-registry", "warning", F.col("d.key")),
        named(deps.where(F.col("d.key").isin(*DEPRECATED)), "deprecated-package", F.try_element_at(old, F.col("d.key")), F.col("d.key")),
        named(m.where("m.overrides is not null or m.resolutions is not null"), "overrides", "info", F.when(F.col("m.overrides").isNotNull(), "overrides").otherwise("resolutions")),
        named(m.where(F.col("m.publishConfig.registry").isNotNull() & ~F.col("m.publishConfig.registry").contains("registry.npmjs.org") & ~F.coalesce(F.col("m.name"), F.lit("")).startswith("@")), "private-registry", "info", F.col("m.publishConfig.registry")),
        named(m.join(lock, ["repo", "folder"], "left_anti"), "no-lockfile", "warning", F.lit("")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def npmrc_issues(files: DataFrame) -> DataFrame:
    """path, line_no, rule_id of .npmrc files: the first line with a literal credential, and registries without TLS."""
    lines = to_lines(files.where(F.col("path").rlike(r"(?:^|/)\.npmrc$"))).where(~F.trim("text").startswith("#"))
    value = F.trim(F.regexp_extract("text", "=(.*)$", 1))
    auth = lines.where(F.col("text").rlike(r"(?i)_(?:authToken|password)\s*=") & ~value.isin("", '""', "''") & ~value.startswith("${")).groupBy("path").agg(F.min("line_no").alias("line_no"))
    plain = lines.where(F.col("text").rlike(r"(?i)registry\s*=\s*http://"))
    return auth.select("path", "line_no", F.lit("npmrc-auth").alias("rule_id")).unionByName(plain.select("path", "line_no", F.lit("http-registry").alias("rule_id")))


def lockfile_integrity(files: DataFrame) -> DataFrame:
    """path, missing, first: entries of package-lock files that are fetched but have no integrity, and the first of them by name."""
    locks = files.where(F.col("path").rlike(r"(?:^|/)package-lock\.json$")).select("path", F.from_json("content", "packages map<string,struct<resolved:string,integrity:string,link:boolean>>").alias("m"))
    bare = F.filter(F.map_entries("m.packages"), lambda e: (e["key"] != "") & e["value"]["resolved"].isNotNull() & e["value"]["integrity"].isNull() & ~F.coalesce(e["value"]["link"], F.lit(False)))
    return locks.select("path", F.transform(bare, lambda e: e["key"]).alias("bare")).where("size(bare) > 0").select("path", F.size("bare").cast("long").alias("missing"), F.array_min("bare").alias("first"))


#: Versions that no registry serves: workspaces, files, links, addresses, repositories.
ELSEWHERE = r"^(?:workspace:|file:|link:|https?://|git(?:\+https?)?://)|/"


def from_registry(deps: DataFrame, version: str = "version") -> DataFrame:
    return deps.where(~F.col(version).rlike(ELSEWHERE))


OSV = "vulns array<struct<id:string,summary:string,aliases:array<string>,severity:array<struct<type:string,score:string>>,affected:array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>>>,references:array<struct<type:string,url:string>>,published:string,database_specific:struct<severity:string>>>"


def osv_table(answers: DataFrame) -> DataFrame:
    """(pkg, version, content: a vulnerability database's JSON answer) -> pkg, version, cve_id, aliases, summary, severity,
    fixed, reference, published. Malformed answers give no rows."""
    v = answers.select("pkg", "version", F.explode(F.from_json("content", OSV)["vulns"]).alias("v"))
    first = lambda items: F.get(items, F.lit(0))
    events = F.flatten(F.flatten(F.transform("v.affected", lambda a: F.coalesce(F.transform(a["ranges"], lambda r: F.coalesce(r["events"], F.array().cast("array<struct<introduced:string,fixed:string>>"))), F.array().cast("array<array<struct<introduced:string,fixed:string>>>")))))
    fixed = first(F.filter(F.transform(events, lambda e: e["fixed"]), lambda x: x.isNotNull() & (x != "")))
    secure = F.filter("v.references", lambda r: r["url"].startswith("https://"))
    reference = F.coalesce(first(F.filter(secure, lambda r: r["type"] == "ADVISORY")), first(secure))["url"]
    scores = F.filter(F.transform("v.severity", lambda s: F.regexp_extract(s["score"], r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")), lambda x: x.isNotNull() & (x <= 10))
    return v.select(
        "pkg", "version", F.coalesce(first(F.filter("v.aliases", lambda a: a.startswith("CVE-"))), F.col("v.id"), F.lit("UNKNOWN")).alias("cve_id"), F.coalesce("v.aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("v.summary", F.lit("No description available")).alias("summary"),
        severity_of(F.col("v.database_specific.severity"), first(scores).cast("string")).alias("severity"), fixed.alias("fixed"), reference.alias("reference"), F.col("v.published").alias("published"),
    )


def dependency_report(deps: DataFrame, registry: DataFrame, cves: DataFrame) -> DataFrame:
    """deps (pkg, version, is_dev), registry (pkg, latest, downloads), cves (pkg, severity) -> both with cves and how far
    behind: major, minor, patch, or null."""
    n = cves.groupBy("pkg").agg(F.count("*").alias("cves"))
    out = deps.join(registry, "pkg", "left").join(n, "pkg", "left").na.fill(0, ["cves"])
    part = lambda c, k: F.coalesce(F.get(version_key(F.col(c)), F.lit(k)), F.lit(0))
    behind = F.when(F.col("latest").isNull(), None).when(part("version", 0) < part("latest", 0), "major").when((part("version", 0) == part("latest", 0)) & (part("version", 1) < part("latest", 1)), "minor").when((part("version", 0) == part("latest", 0)) & (part("version", 1) == part("latest", 1)) & (part("version", 2) < part("latest", 2)), "patch")
    return out.withColumn("behind", behind)


def dependency_summary(report: DataFrame) -> DataFrame:
    c = lambda cond: F.count(F.when(cond, 1))
    return report.agg(F.count("*").alias("total"), F.sum("cves").cast("long").alias("cves"), c(F.col("cves") > 0).alias("vulnerable"), *(c(F.col("behind") == k).alias(k) for k in ("major", "minor", "patch")), c(F.col("behind").isNotNull()).alias("outdated"))


def sorted_dependencies(report: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """A dependency table by one of its columns, ties by name; the type sorts production before development."""
    key = {"name": F.lower("pkg"), "type": F.col("is_dev").cast("int"), "downloads": F.coalesce("downloads", F.lit(0))}.get(by, F.col(by))
    return report.orderBy(key.desc() if descending else key.asc(), F.lower("pkg"))


def workflow_issues(files: DataFrame) -> DataFrame:
    """path, line_no, rule_id of workflow files: unpinned actions, dangerous triggers, injected input, wide permissions."""
    lines = to_lines(files.where(F.col("path").rlike(r"\.github/workflows/[^/]+\.ya?ml$")))
    t = F.col("text")
    rules = (
        ("gha-unpinned-action", t.rlike(r"^\s*-?\s*uses:\s*[^\s@]+@(?![0-9a-f]{40}\b)\S+") & ~t.rlike(r"uses:\s*\./")),
        ("gha-dangerous-trigger", t.rlike(r"\bpull_request_target\b")),
        ("gha-script-injection", t.rlike(r"\$\{\{\s*github\.event\.(?:issue|pull_request|comment|head_commit)[^}]*(?:title|body|message|ref)\b")),
        ("gha-permissions-write-all", t.rlike(r"^\s*permissions:\s*write-all\b")),
    )
    return lines.select("path", "line_no", F.explode(F.array_compact(F.array(*(F.when(c, r) for r, c in rules)))).alias("rule_id"))


def unpinned_requirements(files: DataFrame) -> DataFrame:
    """path, line_no, text of requirement lines without an exact version."""
    lines = to_lines(files.where(F.col("path").rlike(r"requirements[^/]*\.txt$")))
    return lines.where(F.col("text").rlike(r"^\s*[A-Za-z0-9]") & ~F.col("text").rlike(r"==|===|@\s"))


def version_key(version: Column) -> Column:
    """An array that orders dotted versions."""
    return F.transform(F.split(F.regexp_replace(version, r"[^0-9.].*$", ""), r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(0).cast("long")))


def vulnerable(deps: DataFrame, ranges: DataFrame) -> DataFrame:
    """deps (repo, pkg, version) in ranges (pkg, id, introduced, fixed, severity): introduced <= version < fixed, where fixed
    may be null. One row for a dependency and id, with the lowest fixed version and the worst severity."""
    v = version_key(F.col("version"))
    hit = deps.join(ranges, "pkg").where((version_key(F.col("introduced")) <= v) & (F.col("fixed").isNull() | (v < version_key(F.col("fixed")))))
    return hit.groupBy("repo", "pkg", "version", "id").agg(F.min_by("fixed", version_key(F.col("fixed"))).alias("fixed"), F.min_by("severity", ordinal(F.lower("severity"), LEVELS)).alias("severity"))


def severity_of(given: Column, cvss: Column) -> Column:
    """The named severity, else by numeric score, else medium."""
    named, score = F.lower(given), F.regexp_extract(cvss, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(named.isin("critical", "high", "low"), named).when(named.isin("moderate", "medium"), "medium").when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score.isNotNull(), "low").otherwise("medium")
