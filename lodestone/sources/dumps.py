"""JSON dumps of a hosting service's answers as tables: repositories, trees, commits, comparisons, pull requests, blame.

Each function takes a DataFrame with the answers as text in `content` (one answer a row, and the columns in `by`), so dumps
can come from files, tables or streams. Malformed answers and missing fields give nulls or no rows, never errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPOSITORY = "id long, full_name string, description string, html_url string, default_branch string, language string, stargazers_count long, forks_count long, open_issues_count long, size long, fork boolean, parent struct<full_name:string>, topics array<string>, license struct<spdx_id:string>, pushed_at timestamp, private boolean"
TREE = "sha string, truncated boolean, tree array<struct<path:string,mode:string,type:string,sha:string,size:long>>"
PERSON = "struct<name:string,email:string,date:timestamp>"
COMMITS = f"array<struct<sha:string,html_url:string,commit:struct<message:string,author:{PERSON},committer:{PERSON}>,author:struct<login:string,avatar_url:string>,parents:array<struct<sha:string>>>>"
FILES = "array<struct<filename:string,status:string,additions:long,deletions:long,patch:string>>"
COMPARISON = f"status string, ahead_by long, behind_by long, total_commits long, files {FILES}"
PULL = "number long, title string, state string, merged boolean, user struct<login:string>, base struct<ref:string>, head struct<ref:string>, additions long, deletions long, changed_files long"
NAMED = "array<struct<name:string,commit:struct<sha:string>>>"
BLAME = "array<struct<startingLine:int,endingLine:int,age:int,commit:struct<oid:string,messageHeadline:string,committedDate:timestamp,author:struct<name:string,email:string,user:struct<login:string>>>>>"


def _parsed(answers: DataFrame, schema: str, by: list[str]) -> DataFrame:
    return answers.select(*by, F.from_json("content", schema).alias("x")).where("x is not null")


def repositories(answers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for a repository, with owner and name apart and counts of 0 where they are missing."""
    x = _parsed(answers, REPOSITORY, by or []).where("x.full_name is not null")
    n = lambda c: F.coalesce(f"x.{c}", F.lit(0)).cast("long")
    return x.select(*(by or []), "x.id", "x.full_name", F.substring_index("x.full_name", "/", 1).alias("owner"), F.substring_index("x.full_name", "/", -1).alias("name"), "x.description", F.col("x.html_url").alias("url"), F.coalesce("x.default_branch", F.lit("main")).alias("default_branch"), "x.language", n("stargazers_count").alias("stars"), n("forks_count").alias("forks"), n("open_issues_count").alias("open_issues"), n("size").alias("size_kb"), F.coalesce("x.fork", F.lit(False)).alias("is_fork"), F.col("x.parent.full_name").alias("parent_full_name"), F.coalesce("x.topics", F.array().cast("array<string>")).alias("topics"), F.col("x.license.spdx_id").alias("license"))


def trees(answers: DataFrame, by: list[str]) -> DataFrame:
    """by..., tree_sha, ordinal, path, type, sha, size: entries of recursive tree listings, in their order."""
    x = _parsed(answers, TREE, by)
    return x.select(*by, F.col("x.sha").alias("tree_sha"), F.posexplode("x.tree").alias("ordinal", "e")).select(*by, "tree_sha", "ordinal", "e.path", "e.type", "e.sha", F.coalesce("e.size", F.lit(0)).cast("long").alias("size"))


def commits(answers: DataFrame, by: list[str]) -> DataFrame:
    x = _parsed(answers, COMMITS, by).select(*by, F.explode("x").alias("c"))
    return x.select(*by, "c.sha", "c.commit.message", F.col("c.commit.author.name").alias("author_name"), F.col("c.commit.author.email").alias("author_email"), F.col("c.commit.author.date").alias("author_date"), F.col("c.commit.committer.date").alias("committer_date"), F.col("c.author.login").alias("author_login"), F.col("c.author.avatar_url").alias("author_avatar_url"), F.col("c.html_url").alias("url"), F.coalesce(F.size("c.parents"), F.lit(0)).alias("n_parents"))


def comparisons(answers: DataFrame, by: list[str]) -> DataFrame:
    """by..., status, ahead, behind, path, change, additions, deletions, patch: the files of comparisons of two revisions."""
    x = _parsed(answers, COMPARISON, by)
    return x.select(*by, "x.status", F.col("x.ahead_by").alias("ahead"), F.col("x.behind_by").alias("behind"), F.explode_outer("x.files").alias("f")).select(*by, "status", "ahead", "behind", F.col("f.filename").alias("path"), F.col("f.status").alias("change"), "f.additions", "f.deletions", "f.patch")


def change_stats(files: DataFrame, by: list[str]) -> DataFrame:
    return files.groupBy(*by).agg(F.count("path").alias("files"), F.coalesce(F.sum("additions"), F.lit(0)).cast("long").alias("additions"), F.coalesce(F.sum("deletions"), F.lit(0)).cast("long").alias("deletions"))


def pulls(answers: DataFrame, by: list[str]) -> DataFrame:
    x = _parsed(answers, PULL, by).where("x.number is not null")
    return x.select(*by, "x.number", "x.title", F.when(F.col("x.merged"), "merged").otherwise(F.col("x.state")).alias("state"), F.col("x.user.login").alias("author"), F.col("x.base.ref").alias("base"), F.col("x.head.ref").alias("head"), "x.additions", "x.deletions", "x.changed_files")


def refs(answers: DataFrame, by: list[str]) -> DataFrame:
    """by..., name, sha: of branches or tags."""
    return _parsed(answers, NAMED, by).select(*by, F.explode("x").alias("r")).select(*by, "r.name", F.col("r.commit.sha").alias("sha"))


def blame(answers: DataFrame, by: list[str]) -> DataFrame:
    """by..., start_line, end_line, age, sha, headline, date, author_name, author_email, author_login."""
    x = _parsed(answers, BLAME, by).select(*by, F.explode("x").alias("r"))
    return x.select(*by, F.col("r.startingLine").alias("start_line"), F.col("r.endingLine").alias("end_line"), "r.age", F.col("r.commit.oid").alias("sha"), F.col("r.commit.messageHeadline").alias("headline"), F.col("r.commit.committedDate").alias("date"), F.col("r.commit.author.name").alias("author_name"), F.col("r.commit.author.email").alias("author_email"), F.col("r.commit.author.user.login").alias("author_login"))


def without_content(files: DataFrame) -> DataFrame:
    """An index of names only: no text, no lines."""
    return files.select(*(c for c in files.columns if c not in ("content", "line_count")), F.lit("").alias("content"), F.lit(0).alias("line_count"))
