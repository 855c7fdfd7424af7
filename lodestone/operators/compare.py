"""Comparison of repositories by shared items. items: (repo, item), distinct or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the parts of a similarity, and its labels.
WEIGHTS = {"sha": 0.40, "containment": 0.10, "path": 0.25, "dependency": 0.15, "language": 0.10}
LABELS = ((0.80, "likely-clone"), (0.50, "highly-similar"), (0.20, "some-overlap"))


def shared_counts(items: DataFrame) -> DataFrame:
    """a, b (a < b), shared, size_a, size_b of repos that share an item. For each item the set of its repos is gathered
    first (there are few repos), so items in one repo make no pairs."""
    one = items.select("repo", "item").distinct()
    sizes = one.groupBy("repo").agg(F.count("*").alias("size"))
    together = one.groupBy("item").agg(F.sort_array(F.collect_set("repo")).alias("repos")).where("size(repos) > 1").groupBy("repos").agg(F.count("*").alias("n"))
    pairs = together.select(F.posexplode("repos").alias("i", "a"), "repos", "n").select("a", F.explode(F.expr("slice(repos, i + 2, size(repos))")).alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    side = lambda c: sizes.select(F.col("repo").alias(c), F.col("size").alias(f"size_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    return F.when(a + b - shared > 0, shared / (a + b - shared)).otherwise(0.0)


def containment(shared: Column, a: Column, b: Column) -> Column:
    return F.when(F.least(a, b) > 0, shared / F.least(a, b)).otherwise(0.0)


def cosine(weights: DataFrame) -> DataFrame:
    """(repo, item, w) -> a, b, cosine, for repos that share an item: a join on items, each held by few repos."""
    w = weights.groupBy("repo", "item").agg(F.sum("w").cast("double").alias("w"))
    norms = w.groupBy("repo").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = w.alias("x").join(w.alias("y"), (F.col("x.item") == F.col("y.item")) & (F.col("x.repo") < F.col("y.repo"))).groupBy(F.col("x.repo").alias("a"), F.col("y.repo").alias("b")).agg(F.sum(F.col("x.w") * F.col("y.w")).alias("dot"))
    side = lambda c: norms.select(F.col("repo").alias(c), F.col("norm").alias(f"norm_{c}"))
    return dots.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.when(F.col("norm_a") * F.col("norm_b") > 0, F.col("dot") / (F.col("norm_a") * F.col("norm_b"))).otherwise(0.0).alias("cosine"))


def overall(parts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for k, v in parts.items():
        out = out + WEIGHTS[k] * F.coalesce(v, F.lit(0.0))
    return out


def label(similarity: Column) -> Column:
    out = F.lit("different")
    for least, name in reversed(LABELS):
        out = F.when(similarity >= least, name).otherwise(out)
    return out


def shared_and_unique(deps: DataFrame) -> DataFrame:
    """(repo, pkg, version, is_dev) -> pkg, n_repos, versions map, kind (shared with 2 repos or more, else unique); a dev
    dependency's version wins over another of its repo."""
    one = deps.groupBy("repo", "pkg").agg(F.max_by("version", "is_dev").alias("version"))
    return one.groupBy("pkg").agg(F.count("*").alias("n_repos"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("repo", "version")))).alias("versions")).withColumn("kind", F.when(F.col("n_repos") >= 2, "shared").otherwise("unique"))


def identical(files: DataFrame, a: str, b: str) -> DataFrame:
    """Files (repo, path, sha) of repo a whose content is in repo b too; of equal contents the last path stays."""
    own = files.where(F.col("repo") == a).groupBy("sha").agg(F.max("path").alias("path"))
    return own.join(files.where(F.col("repo") == b).select("sha"), "sha", "left_semi")


# Fixed lists: files that any repository may have, folders and beginnings of names of such files.
BOILERPLATE = tuple(".gitignore .gitattributes .editorconfig license license.md license.txt .prettierrc .prettierrc.json .prettierrc.js .prettierrc.yaml .eslintrc .eslintrc.json .eslintrc.js .eslintrc.yaml eslint.config.js eslint.config.mjs tsconfig.json package-lock.json yarn.lock pnpm-lock.yaml".split())
BOILERPLATE_FOLDERS = (".github/", ".vscode/")
BOILERPLATE_NAMES = ("tsconfig.", "postcss.config.", "tailwind.config.", "next.config.", "vite.config.", "vitest.config.")


def boilerplate(path: Column) -> Column:
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    out = name.isin(*BOILERPLATE)
    for f in BOILERPLATE_FOLDERS:
        out = out | low.startswith(f)
    for n in BOILERPLATE_NAMES:
        out = out | name.startswith(n)
    return out


def fork_relations(repos: DataFrame) -> DataFrame:
    """(full_name, is_fork, parent_full_name) -> a, b, parent: pairs of which one was forked from the other, or both from one.
    Equi-joins on the parent, so pairs without a relation never meet. Forks of one parent are kept as pairs with the first of
    them, and with the parent if it is here; that says all that pairs of siblings would."""
    forks = repos.where("is_fork and parent_full_name is not null").select("full_name", F.col("parent_full_name").alias("parent"))
    direct = forks.join(repos.select(F.col("full_name").alias("parent")), "parent", "left_semi").select(F.least("full_name", "parent").alias("a"), F.greatest("full_name", "parent").alias("b"), "parent")
    first = forks.groupBy("parent").agg(F.min("full_name").alias("first"))
    siblings = forks.join(first, "parent").where("full_name <> first").select(F.col("first").alias("a"), F.col("full_name").alias("b"), "parent")
    return direct.unionByName(siblings).distinct()


def repository_metrics(tree: DataFrame) -> DataFrame:
    """(repo, path, size, language) -> repo, files, lines (size / 25, rounded, of each file), languages map."""
    from lodestone.functions.text import round_half_up

    counts = tree.groupBy("repo", "language").agg(F.count("*").alias("n"), F.sum(round_half_up(F.col("size") / 25, 0)).cast("long").alias("lines"))
    return counts.groupBy("repo").agg(F.sum("n").alias("files"), F.sum("lines").alias("lines"), F.map_from_entries(F.array_compact(F.sort_array(F.collect_list(F.when(F.col("language").isNotNull(), F.struct("language", "n")))))).alias("languages"))
