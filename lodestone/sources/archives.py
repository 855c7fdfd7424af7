"""Zip archives as a source: entries are read where Spark places them, and no archive is a row or a task of its own.

The end of an archive lists its entries. Planning reads that list alone, drops what isn't wanted, keeps to the caps by the sizes that it
states, and cuts what is left into runs of entries of about `range_bytes` compressed bytes. A partition is a run: its task reads the list again, and then
only its entries' byte ranges. So a lost task costs its run.

    spark.dataSource.register(ZipEntries)
    spark.read.format("zip_entries").option("path", "file:///data/*.zip").load()
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of an entry, and of all entries of an archive, that are read.
MAX_FILE, MAX_TOTAL = 500_000, 200_000_000
#: Compressed bytes of a partition.
RANGE_BYTES = 16 << 20
# Fixed list: extensions of files that are indexed.
INDEXABLE = frozenset("ts tsx js jsx mjs cjs py rb go rs java kt swift cs cpp c h hpp php vue svelte html css scss sass json yaml yml md mdx sql graphql sh bash zsh dockerfile".split())


@dataclass
class Run(InputPartition):
    """Entries `first` to `last` (not included) of an archive's wanted ones."""

    archive: str
    first: int
    last: int


def inner_path(name: str) -> str:
    """The path below the archive's first folder; empty for what isn't wanted."""
    inner = name.partition("/")[2]
    return "" if name.endswith("/") or ".." in inner.split("/") or inner.rpartition("/")[2].rpartition(".")[2].lower() not in INDEXABLE else inner


def wanted(entries: list[zipfile.ZipInfo], max_file: int = MAX_FILE, max_total: int = MAX_TOTAL) -> list[tuple[int, str, zipfile.ZipInfo]]:
    """(ordinal, path, entry) of the entries that are read, in the archive's order: up to the first that would pass the total."""
    out, total = [], 0
    for k, info in enumerate(entries):
        path = inner_path(info.filename)
        if not path or info.file_size > max_file:
            continue
        total += info.file_size
        if total > max_total:
            break
        out.append((k, path, info))
    return out


def runs(sizes: list[int], range_bytes: int = RANGE_BYTES) -> list[tuple[int, int]]:
    """(first, last) of runs of about so many bytes, one entry at least."""
    out, start, held = [], 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > range_bytes:
            out.append((start, k))
            start, held = k, 0
        held += size
    return [*out, (start, len(sizes))] if sizes else []


def matching(pattern: str) -> list[str]:
    """URIs of the files that a path names, with * and ? in its last part."""
    uri = pattern if "://" in pattern or pattern.startswith("file:") else f"file://{pattern}"
    head, _, last = uri.rpartition("/")
    if not any(c in last for c in "*?["):
        return [uri]
    fs, root = pafs.FileSystem.from_uri(head)
    return sorted(f"{head}/{f.base_name}" for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and fnmatch.fnmatch(f.base_name, last))


class Seekable(io.RawIOBase):
    """A file of pyarrow's as zipfile expects it: a place outside is an OSError."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        return self.file.read(None if size is None or size < 0 else size)

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("before the file's start")
        return self.file.seek(min(at, self.file.size()))

    def close(self) -> None:
        self.file.close()
        super().close()


def opened(uri: str) -> zipfile.ZipFile:
    fs, name = pafs.FileSystem.from_uri(uri)
    return zipfile.ZipFile(Seekable(fs.open_input_file(name)))


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.caps = int(options.get("maxfile", MAX_FILE)), int(options.get("maxtotal", MAX_TOTAL))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for uri in matching(self.path):
            with opened(uri) as z:
                sizes = [info.compress_size for _, _, info in wanted(z.infolist(), *self.caps)]
            out += [Run(uri, a, b) for a, b in runs(sizes, self.range_bytes)]
        return out or [Run("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, Run) or not partition.archive:
            return
        with opened(partition.archive) as z:
            for k, path, info in wanted(z.infolist(), *self.caps)[partition.first : partition.last]:
                yield partition.archive, k, path, z.read(info).decode("utf-8", "replace"), info.file_size


class ZipEntries(DataSource):
    """archive string, ordinal long, path string, content string, size long: the text files in zip archives. The first folder is dropped, and so are folders, paths with `..`, other
    extensions and files beyond `maxfile`; an archive is read up to the entry that would pass `maxtotal`. Bytes that aren't UTF-8 become replacement
    characters; an entry given twice comes twice; an archive without entries gives none, and a damaged entry fails its task."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return "archive string, ordinal long, path string, content string, size long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipReader({k.lower(): v for k, v in self.options.items()})


def read_zip(spark: SparkSession, path: str, **options: int) -> DataFrame:
    spark.dataSource.register(ZipEntries)
    return spark.read.format("zip_entries").options(**{k: str(v) for k, v in options.items()}).option("path", path).load()
