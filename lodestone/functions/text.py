"""Column functions over text, paths and times."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def search_pattern(query: str, case_sensitive: bool = False, regex: bool = False, whole_word: bool = False) -> str | None:
    """Java pattern for a search box query: None for a blank one; an invalid regex is taken literally; whole words count
    only for literal queries."""
    if not query.strip():
        return None
    body = query
    if regex:
        try:
            re.compile(query)
        except re.error:
            regex = False
    if not regex:
        body = re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", query)
        if whole_word:
            body = rf"\b{body}\b"
    return body if case_sensitive else f"(?i){body}"


def split_lines(text: Column) -> Column:
    """Lines of a text; an empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character, 0 for an empty string."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.length(value).cast("double")
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.length(value) > 0, F.aggregate(each, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


PLACEHOLDER = "(?i)^(?:x+|\\*+|example.*|your[_-].*|changeme|placeholder|<.*>|\\$\\{.*\\}|test.*|dummy.*)$"


def likely_secret(value: Column, bits: float = 3.3, length: int = 8) -> Column:
    """Long and random enough, and no placeholder."""
    return (F.length(value) >= length) & (entropy(value) >= bits) & ~value.rlike(PLACEHOLDER)


#: Redactions, in order: (pattern, replacement).
REDACTIONS: tuple[tuple[str, str], ...] = (
    (r"(?i)((?:password|passwd|secret|token|api_key|apikey)\s*[:=]\s*)[\"'][^\"'\n]{4,}[\"']", '$1"[REDACTED]"'),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[AWS_KEY]"),
    (r"\b[0-9a-f]{32,}\b", "[HEX]"),
)


def redact(text: Column) -> Column:
    for pattern, to in REDACTIONS:
        text = F.regexp_replace(text, pattern, to)
    return text


def normalize_path(path: Column) -> Column:
    """Resolve `.` and `..` segments; `..` above the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolve_path(folder: Column, relative: Column) -> Column:
    """A relative path from a folder; null if it leads above the root."""
    parts = F.filter(F.concat(F.split(folder, "/"), F.split(relative, "/")), lambda p: (p != "") & (p != "."))
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("at"))

    def step(a: Column, p: Column) -> Column:
        up = F.struct((a["ok"] & (F.size(a["at"]) > 0)).alias("ok"), F.slice(a["at"], 1, F.greatest(F.size(a["at"]) - 1, F.lit(0))).alias("at"))
        return F.when(p == "..", up).otherwise(F.struct(a["ok"].alias("ok"), F.concat(a["at"], F.array(p)).alias("at")))

    return F.aggregate(parts, start, step, lambda a: F.when(a["ok"], F.array_join(a["at"], "/")))


def node_id(path: Column) -> Column:
    """Letters and digits of a path, with single underscores for the rest."""
    return F.regexp_replace(F.regexp_replace(path, "[^a-zA-Z0-9]+", "_"), "^_|_$", "")


def short_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 2, path).otherwise(F.concat(F.get(parts, F.lit(0)), F.lit("/.../"), F.element_at(parts, -1)))


def top_folder(path: Column) -> Column:
    return F.get(F.split(path, "/"), F.lit(0))


def short_count(n: Column, digits: int = 1) -> Column:
    """1234 as 1.2K, 3000000 as 3M."""
    def of(unit: int, mark: str) -> Column:
        return F.when(n % unit == 0, F.concat((n / unit).cast("long").cast("string"), F.lit(mark))).otherwise(F.concat(F.format_string(f"%.{digits}f", n / unit), F.lit(mark)))

    return F.when(n >= 1_000_000, of(1_000_000, "M")).when(n >= 1000, of(1000, "K")).otherwise(n.cast("string"))


def dollars(cost: Column) -> Column:
    return F.when(cost < 0.01, F.format_string("$%.4f", cost)).otherwise(F.format_string("$%.2f", cost))


def model_name(id_: Column) -> Column:
    """Words of a model's id, capitalised, without its folder."""
    bare = F.regexp_replace(id_, r"^(?:models/|accounts/[^/]+/models/)", "")
    return F.array_join(F.transform(F.split(bare, "[-_]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")


def index_budget(tokens: Column) -> Column:
    """Characters of an index for a context of so many tokens: 15 % of it, or 10 % beyond 200,000; a million at most."""
    return F.least(F.floor(tokens * 4 * F.when(tokens <= 200_000, 0.15).otherwise(0.10)).cast("long"), F.lit(1_000_000).cast("long"))


def day_label(day: Column, today: Column) -> Column:
    """Today, Yesterday, or the date in words."""
    return F.when(day == today, "Today").when(day == F.date_sub(today, 1), "Yesterday").otherwise(F.date_format(day, "MMMM d, yyyy"))


def vector(severity: Column, confidence: Column, category: Column, cwe: Column) -> Column:
    """S:.../C:.../CAT:.../CWE:... of a finding."""
    number = F.regexp_replace(cwe, "(?i)^CWE-", "")
    return F.concat_ws("/", F.concat(F.lit("S:"), severity), F.concat(F.lit("C:"), F.coalesce(confidence, F.lit("medium"))), F.concat(F.lit("CAT:"), category), F.when(F.coalesce(cwe, F.lit("")) != "", F.concat(F.lit("CWE:"), number)))


REPO_URL = r"^(?:https?://)?(?:www\.)?github\.com/([^/?#]+)/([^/?#]+?)(?:\.git)?(?:/(?:tree|blob)/([^/?#]+)(?:/([^?#]*?))?)?/?(?:[?#].*)?$"


def repository(url: Column) -> Column:
    """struct<owner, repo, branch, path> of an address or of owner/repo; null if it is neither."""
    u = F.trim(url)
    part = lambda k: F.nullif(F.regexp_extract(u, REPO_URL, k), F.lit(""))
    short = u.rlike(r"^[\w.-]+/[\w.-]+$")
    split = F.split(u, "/")
    none = F.lit(None).cast("string")
    return F.when(short, F.struct(F.get(split, F.lit(0)).alias("owner"), F.get(split, F.lit(1)).alias("repo"), none.alias("branch"), none.alias("path"))).when(u.rlike(REPO_URL), F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).alias("branch"), part(4).alias("path")))


def share_link(owner: Column, repo: Column, view: Column) -> Column:
    """/owner/repo, with ?view= unless it is the first one."""
    return F.concat(F.lit("/"), owner, F.lit("/"), repo, F.when(view.isNotNull() & (view != "repo"), F.concat(F.lit("?view="), view)).otherwise(""))


#: Functions for SQL: arguments, type and body.
SQL_FUNCTIONS = {
    "lodestone_line_count": ("text STRING", "INT", "length(text) - length(replace(text, '\n', '')) + 1"),
    "lodestone_entropy": ("value STRING", "DOUBLE", "aggregate(transform(array_distinct(filter(split(value, ''), c -> c <> '')), c -> (length(value) - length(replace(value, c, ''))) / length(value)), 0D, (a, p) -> a - p * log2(p))"),
    "lodestone_parent_path": ("path STRING", "STRING", "CASE WHEN instr(path, '/') > 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"),
    "lodestone_node_id": ("path STRING", "STRING", "regexp_replace(regexp_replace(path, '[^a-zA-Z0-9]+', '_'), '^_|_$', '')"),
}


def register(spark) -> list[str]:
    """Make the functions of SQL_FUNCTIONS known to the session's SQL; their names."""
    for name, (arguments, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(SQL_FUNCTIONS)


def parent_path(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9_]+)$", 1))


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits, on the binary value."""
    k = 10**digits
    return F.floor(x * k + 0.5) / k


def ordinal(value: Column, names: Sequence[str]) -> Column:
    """Place of a value in a list, from 0; one more than the last for others."""
    out = F.lit(len(names))
    for i, name in reversed(list(enumerate(names))):
        out = F.when(value == name, i).otherwise(out)
    return out


def strip_version(version: Column) -> Column:
    """The bare version of a dependency range."""
    return F.regexp_replace(F.trim(version), r"^(?:[\^~]|[<>]=?|=|v)\s*", "")


def glob_filter(path: Column, globs: str) -> Column:
    """Comma-separated `*.ext`, `dir/*` and plain substrings, or-ed; none match all."""
    found = None
    for g in filter(None, map(str.strip, globs.split(","))):
        one = path.endswith(g[1:]) if g.startswith("*.") else path.startswith(g[:-1]) if g.endswith("/*") else path.contains(g)
        found = one if found is None else found | one
    return F.lit(True) if found is None else found
