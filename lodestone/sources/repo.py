"""Repository sources and sinks: archives, trees, manifests, JSON and text reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import extension, parent_path, strip_version

MAX_FILE, MAX_TOTAL = 500_000, 200_000_000
# Fixed list: extensions of files that are indexed.
INDEXABLE = tuple("ts tsx js jsx mjs cjs py rb go rs java kt swift cs cpp c h hpp php vue svelte html css scss sass json yaml yml md mdx sql graphql sh bash zsh dockerfile".split())


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, path, content, size of the text files in zip archives: the first folder is dropped, and so are folders,
    paths with `..`, other extensions, long files, and what lies beyond the total of an archive, which is unpacked no further."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, raw in zip(f["path"], f["content"], strict=True):
                rows, held, total = [], 0, 0
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for k, info in enumerate(z.infolist()):
                        inner = info.filename.partition("/")[2]
                        if info.is_dir() or not inner or ".." in inner.split("/") or info.file_size > MAX_FILE or inner.rpartition("/")[2].rpartition(".")[2].lower() not in INDEXABLE:
                            continue
                        total += info.file_size
                        if total > MAX_TOTAL:
                            break
                        rows.append((name, k, inner, z.read(info).decode("utf-8", "replace"), info.file_size))
                        held += info.file_size
                        if held > 8_000_000:
                            yield pd.DataFrame(rows, columns=["archive", "ordinal", "path", "content", "size"])
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=["archive", "ordinal", "path", "content", "size"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, ordinal long, path string, content string, size long")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all text files below a folder."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def indexable(tree: DataFrame) -> DataFrame:
    return tree.where(extension(F.col("path")).isin(*INDEXABLE) & (F.col("size") <= MAX_FILE))


def hierarchy(tree: DataFrame) -> DataFrame:
    """Flat tree entries (path, type) with parent and depth, in display order: by depth, folders first, then by name in the order of
    people's languages."""
    out = tree.withColumn("parent", parent_path(F.col("path"))).withColumn("depth", F.size(F.split("path", "/")))
    return out.orderBy("depth", (~F.col("type").isin("dir", "tree")).cast("int"), F.collate("path", "UNICODE"))


def manifest_deps(manifests: DataFrame) -> DataFrame:
    """(repo, content of package.json) -> repo, pkg, version, is_dev; malformed manifests have none."""
    parsed = manifests.select("repo", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("m"))
    part = lambda c, dev: parsed.select("repo", F.explode(f"m.{c}").alias("pkg", "range")).withColumn("is_dev", F.lit(dev))
    return part("dependencies", False).unionAll(part("devDependencies", True)).select("repo", "pkg", strip_version(F.col("range")).alias("version"), "is_dev")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
