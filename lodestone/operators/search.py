"""Line index and search. files: (path, content, ordinal); paths may be of any type."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import line_count, search_pattern, split_lines


def to_lines(files: DataFrame, path: str = "path", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """path, keep..., line_no (from 1), text: one row for each line."""
    return files.select(F.col(path).alias("path"), *keep, F.posexplode(split_lines(F.col(content))).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


#: Escaped characters and character classes; what depends on where a line starts or ends, or on how far a part of a match
#: runs: anchors, lookarounds, atomic groups, possessive quantifiers, comments.
ATOMS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", re.DOTALL)
LINE_BOUND = re.compile(r"[\^$]|\(\?(?:<?[=!]|>|[A-Za-z]*[xX])|[*+?}]\+")
BOUND_ESCAPES = re.compile(r"\\(?:[AzZGQRXn]|b\{)")


def whole_text(pattern: str) -> bool:
    """A text that has a line with a match has a match itself, so that texts can be tested before lines are made. (?m) doesn't
    give that for anchors: `\\r$` and `^$` match lines of texts that they don't match then."""
    return not BOUND_ESCAPES.search(pattern.replace("\\\\", "")) and not LINE_BOUND.search(ATOMS.sub("_", pattern))


def search(files: DataFrame, query: str, path: str = "path", content: str = "content", **how) -> DataFrame:
    """path, line_no, text, n: lines with matches and their counts. Whole texts without a match are skipped before lines
    are made where the pattern allows it, so cost follows the matches."""
    pattern = search_pattern(query, **how)
    if pattern is None:
        return to_lines(files.limit(0), path, content).withColumn("n", F.lit(0).cast("long"))
    hit = files.where(F.col(content).rlike(pattern)) if whole_text(pattern) else files
    lines = to_lines(hit, path, content)
    return lines.where(F.col("text").rlike(pattern)).withColumn("n", F.size(F.regexp_extract_all("text", F.lit(pattern), 0)).cast("long"))


def rank_files(matches: DataFrame, k: int = 50) -> DataFrame:
    """path, n_lines, n: files by matches, most first, ties by path."""
    return matches.groupBy("path").agg(F.count("*").alias("n_lines"), F.sum("n").alias("n")).orderBy(F.desc("n"), "path").limit(k)


def search_partial(files: DataFrame, query: str, path: str = "path", content: str = "content", **how) -> tuple[DataFrame, DataFrame]:
    """Matches of files with content, and the paths that couldn't be searched."""
    return search(files, query, path, content, **how), files.where(F.col(content).isNull() | (F.col(content) == "")).select(F.col(path).alias("path"))


def line_context(files: DataFrame, query: str, before: int = 5, after: int = 5, path: str = "path", content: str = "content", **how) -> DataFrame:
    """path, hit_line, line_no, text: lines around the lines that match, from each file's array of lines: nothing is joined."""
    pattern = search_pattern(query, **how)
    none = to_lines(files.limit(0), path, content).select("path", F.col("line_no").alias("hit_line"), "line_no", "text")
    if pattern is None:
        return none
    hit = files.where(F.col(content).rlike(pattern)) if whole_text(pattern) else files
    rows = hit.select(F.col(path).alias("path"), split_lines(F.col(content)).alias("lines"))
    hits = F.array_compact(F.transform("lines", lambda t, i: F.when(t.rlike(pattern), i + 1)))
    rows = rows.select("path", "lines", F.explode(hits).alias("hit_line"))
    around = F.sequence(F.greatest(F.col("hit_line") - before, F.lit(1)), F.least(F.col("hit_line") + after, F.size("lines")))
    return rows.select("path", "hit_line", "lines", F.explode(around).alias("line_no")).select("path", "hit_line", "line_no", F.get("lines", F.col("line_no") - 1).alias("text"))


def index_totals(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return files.agg(F.countDistinct(path).alias("files"), F.sum(line_count(F.coalesce(F.col(content), F.lit("")))).cast("long").alias("lines"))


def upsert(base: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """Rows of `changes` replace those of `base`; a removed file is a change with `removed` true."""
    both = base.withColumn("_new", F.lit(0)).withColumn("removed", F.lit(False)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new")))
    return both.withColumn("_rn", best).where("_rn = 1 and not coalesce(removed, false)").drop("_rn", "_new", "removed")


def replace_all(files: DataFrame, query: str, replacement: str, content: str = "content", **how) -> DataFrame:
    """The texts with all matches replaced."""
    pattern = search_pattern(query, **how)
    return files if pattern is None else files.withColumn(content, F.regexp_replace(content, pattern, replacement))
