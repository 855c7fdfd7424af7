"""Web pages as WARC files: the same pages give the same files, byte for byte, however Spark dealt them.

* Shards are ranges of page_id. Their bounds come from exact sums of payload bytes over slices of the id's range (slices
  that are too heavy are cut again), not from a sample, so they depend on the pages alone. Within a shard records are
  sorted by page_id, payload digest and URL, and files roll when their compressed size passes `file_bytes`.
* Every record is a gzip member of its own. Headers are made anew from the page: record ids from page_id and digest, lengths,
  and SHA-1 digests of block and payload. Of pages with equal payloads of `min_bytes` or more, the one with the largest
  page_id is a response; the others are revisits that refer to it and hold its HTTP headers but no payload.
* Which pages are revisits is found on digests alone. These marks and the pages go through one shuffle, to the same place, so the
  writer meets a page's mark right before the page: no join moves texts, and no list is broadcast.
* A task writes under a temporary name of its own attempt and returns what it wrote; that list, kept by Spark for one attempt
  of each task, is the manifest. Then files are renamed to their final names (a step that may run again), and the
  manifest is written last. Readers take files from the manifest only, so what failed attempts left is never read.

Costs: pages are read twice (digests, then writing) and shuffled once; the digests' table has some 60 bytes a page.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, ship
from lodestone.llm.textkit import lean

#: Equal payloads of this many bytes are stored once.
MIN_BYTES = 1000
#: Compressed size at which a file rolls.
FILE_BYTES = 64 << 20
#: Payload bytes of a shard: total / SHARDS, within these limits.
SHARD_BYTES, SHARDS = (8 << 20, 1 << 30), 512
#: What a record weighs besides its payload.
RECORD_BYTES = 600
#: Bits of the id's range that the first sums tell apart, and those that each further cut of heavy slices adds.
FIRST_BITS, MORE_BITS = 12, 4
#: Pages have no date of their own, and the same pages must give the same files.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGEST_SCHEMA = "page_id long, digest string, mark long, bytes long"
MANIFEST = "shard int, roll int, name string, temporary string, records long, bytes long, first_id long, last_id long, sha256 string"
PAGES = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long"


def with_payload(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").cast("string").alias("url"), F.coalesce(F.col("`html`").cast("string"), F.lit("")).alias("html"))


def digests(rows: DataFrame) -> DataFrame:
    """(page_id, digest, mark, bytes): SHA-1 and a second hash of each payload, so that a made SHA-1 collision isn't taken for a copy."""
    return rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.xxhash64("html").alias("mark"), F.octet_length("html").cast("long").alias("bytes"))


def revisits(keys: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, mark, refers_to) of the pages whose payload a page with a larger id has too."""
    large = keys.where(F.col("bytes") >= min_bytes)
    last = large.groupBy("digest", "mark", "bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return large.join(last, ["digest", "mark", "bytes"]).where("page_id is null or page_id < refers_to").select("page_id", "digest", "mark", "refers_to").distinct()


def bounds(keys: DataFrame, shard_bytes: int | None = None) -> list[int]:
    """First page_ids of all shards but the first, ascending; a function of the pages alone.

    Slices are prefixes of the id's bits. A slice heavier than a shard is cut by further bits until it isn't, or is one id:
    at most 16 slices for each shard come to the driver in a round, and the rounds are the bits of the range.
    """
    known = keys.where("page_id is not null").select("page_id", (F.col("bytes") + RECORD_BYTES).alias("weight"))
    low, high, total = known.agg(F.min("page_id"), F.max("page_id"), F.sum("weight")).first()
    if low is None or low == high:
        return []
    size = shard_bytes or min(max(total // SHARDS, SHARD_BYTES[0]), SHARD_BYTES[1])
    shift = max(0, (high - low).bit_length() - FIRST_BITS)
    slices: dict[int, int] = {}
    while True:
        found = known.groupBy(F.shiftright("page_id", shift).alias("slice")).agg(F.sum("weight").alias("weight")).collect()
        heavy = [r.slice for r in found if r.weight > size] if shift else []
        cut = set(heavy)
        slices |= {r.slice << shift: r.weight for r in found if r.slice not in cut}
        if not heavy:
            break
        above = keys.sparkSession.createDataFrame([(x,) for x in heavy], "above long")
        known = known.join(F.broadcast(above), F.shiftright("page_id", shift) == F.col("above"), "left_semi")
        shift -= min(MORE_BITS, shift)
    cuts, held = [], 0
    for at in sorted(slices):
        if held and held + slices[at] > size:
            cuts.append(at)
            held = 0
        held += slices[at]
    return cuts


def base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}{f':{copy}' if copy else ''}>"


def header_value(text: str) -> str:
    """One line without white space: that and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member. Its header has no time and no name."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", header_value(url)))
    headers.append(("WARC-Payload-Digest", f"sha1:{base32(bytes.fromhex(digest))}"))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    return record([*headers, ("Content-Type", "application/http;msgtype=response")], http if revisit else http + payload)


class Files:
    """The files of one task's shards, each under a temporary name until the manifest is known."""

    def __init__(self, base: str, file_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(base)
        self.file_bytes, self.attempt = file_bytes, uuid.uuid4().hex
        self.shard, self.roll, self.sink = None, 0, None
        self.done: list[tuple] = []

    def add(self, shard: int, page_id: int | None, packed: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.roll = shard, 0
        if self.sink is None:
            self._open()
        self._put(packed)
        self.records += 1
        self.first = page_id if self.records == 1 else self.first
        self.last = page_id
        if self.size >= self.file_bytes:
            self.close()
            self.roll += 1

    def _open(self) -> None:
        self.name = f"part-{self.shard:06d}-{self.roll:05d}.warc.gz"
        self.temporary = f"_temporary/{self.name}.{self.attempt}"
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.sink = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
        self.size, self.records, self.sha = 0, 0, hashlib.sha256()
        info = b"format: WARC File Format 1.1\r\n"
        self._put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))

    def _put(self, packed: bytes) -> None:
        self.sink.write(packed)
        self.sha.update(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.done.append((self.shard, self.roll, self.name, self.temporary, self.records, self.size, self.first, self.last, self.sha.hexdigest()))
            self.sink = None


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def write_warc(spark: SparkSession, pages: DataFrame, folder: str, scratch: Scratch, file_bytes: int = FILE_BYTES, shard_bytes: int | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write `pages` (page_id, url, html) to WARC files in `folder`, a URI that all executors reach; returns the manifest, a row for each file.

    Null html is an empty payload; a null url leaves the header out; pages with a null page_id come first, in the first shard,
    and are revisits wherever a page with an id has their payload. Rows that repeat a page_id are all written; those with
    equal payload too get record ids of their own, and all those of the largest page_id are responses. Very long pages are
    one record. Further columns are ignored; an empty table gives no files and an empty manifest.
    """
    ship(spark)
    base = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows = with_payload(pages)
    keys = scratch.write(digests(rows), "digests")
    marks = scratch.write(revisits(keys, min_bytes), "revisits")
    cuts = np.array(bounds(keys, shard_bytes), np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), side="right").astype(np.int32))

    # The least id stands for null ones, as pandas has no longs with nulls.
    shard = shard_of(F.coalesce("page_id", F.lit(-(1 << 63)).cast("long")))
    told = marks.select("page_id", "digest", "mark", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    given = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.xxhash64("html").alias("mark"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
    dealt = told.unionByName(given).withColumn("shard", shard).repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "page_id", "digest", "mark", "kind", "url")
    schema = arrow_schema(MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, told_key, refers, key, copy = Files(base, file_bytes), None, None, None, 0
        for b in batches:
            for page_id, digest, mark, kind, refers_to, url, html, shard in zip(*(b.column(c).to_pylist() for c in ("page_id", "digest", "mark", "kind", "refers_to", "url", "html", "shard")), strict=True):
                now = (page_id, digest, mark)
                if kind == 0:
                    told_key, refers = now, refers_to
                    continue
                key, copy = now, copy + 1 if now == key else 0
                files.add(shard, page_id, page_record(page_id, url, html.encode(), digest, refers if now == told_key else None, copy))
        files.close()
        yield batch_of(files.done, schema)

    written = scratch.write(dealt.mapInArrow(lean(write), MANIFEST), "written")
    return commit(spark, written, base, scratch)


def commit(spark: SparkSession, written: DataFrame, base: str, scratch: Scratch) -> DataFrame:
    """Give files their final names and write the manifest after them. A task may run again: what is moved stays moved."""
    schema = arrow_schema(MANIFEST)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        for b in batches:
            for name, temporary, size in zip(*(b.column(c).to_pylist() for c in ("name", "temporary", "bytes")), strict=True):
                if fs.get_file_info(f"{root}/{temporary}").type == pafs.FileType.File:
                    fs.move(f"{root}/{temporary}", f"{root}/{name}")
                elif fs.get_file_info(f"{root}/{name}").size != size:
                    raise FileNotFoundError(f"{name} is neither written nor committed")
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in schema], schema=schema)

    path = f"{base.rstrip('/')}/manifest"
    written.mapInArrow(lean(move), MANIFEST).write.mode("overwrite").parquet(path)
    return spark.read.schema(written.schema).parquet(path)


def members(source) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a file, read in pieces."""
    at, start, unpack, parts, rest = 0, 0, zlib.decompressobj(31), [], b""
    while True:
        piece = rest or source.read(1 << 20)
        if not piece:
            break
        parts.append(unpack.decompress(piece))
        rest = unpack.unused_data
        at += len(piece) - len(rest)
        if unpack.eof:
            yield start, b"".join(parts)
            start, unpack, parts = at, zlib.decompressobj(31), []
        else:
            rest = b""
    if parts and any(parts):
        raise ValueError("cut off within a record")


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; raises if length or block digest don't hold."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n" or headers["warc-block-digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def page_of(headers: dict[str, str], block: bytes) -> tuple[int | None, str | None, str, int | None, int, str, bytes]:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (empty for revisits)."""
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    page = lambda urn: None if (x := urn.strip("<>").split(":")[2]) == "none" else int(x)
    kind = headers["warc-type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"damaged payload of {headers['warc-record-id']}")
    return page(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, page(headers["warc-refers-to"]) if kind == "revisit" else None, length, digest, payload


def read_warc(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The pages of the files a manifest lists, with file and offset of their records, and the payload if asked for (binary, null for revisits)."""
    ship(spark)
    base = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    ddl = PAGES + (", payload binary" if payloads else "")
    schema = arrow_schema(ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, records in zip(b.column("name").to_pylist(), b.column("records").to_pylist(), strict=True):
                fs, root = pafs.FileSystem.from_uri(base)
                out, held, seen = [], 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for offset, content in members(source):
                        headers, block = parse(content)
                        if headers["warc-type"] == "warcinfo":
                            continue
                        *page, payload = page_of(headers, block)
                        out.append((*page, name, offset, *([payload if page[2] == "response" else None] if payloads else ())))
                        seen += 1
                        held += len(payload) if payloads else 200
                        if held > 4 << 20:
                            yield batch_of(out, schema)
                            out, held = [], 0
                if seen != records:
                    raise ValueError(f"{name} has {seen} records, the manifest says {records}")
                yield batch_of(out, schema)

    return manifest.select("name", "records").repartition(max(1, manifest.count())).mapInArrow(lean(read), ddl)


def warc_roundtrip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read every record back."""
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    return read_warc(spark, write_warc(spark, pages, folder, scratch), folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
with payloads as (select page_id, coalesce(html, '') as html from pages),
last as (select html, max(page_id) as last_id from payloads where strlen(html) >= 1000 group by html),
told as (select p.page_id, p.html, case when p.page_id < l.last_id then l.last_id end as refers_to from payloads p left join last l on l.html = p.html)
select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to
from told
"""
