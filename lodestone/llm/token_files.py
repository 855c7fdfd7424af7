"""Token ids in binary files of independent zstandard frames with a trailing seek table.

File format, all integers little-endian:

* one zstandard frame for each run of consecutive documents (about FRAME_IDS ids; a document lies in one frame),
  holding their ids as unsigned 16-bit integers;
* a zstandard skippable frame (magic 0x184D2A5E, so ordinary decompressors pass over it) with one entry per document
  (doc_id int64, null uint8 (1: the doc_id is null), frame uint32, first id within the frame uint64, ids uint64) and one per frame (compressed offset
  uint64, compressed bytes uint64, ids uint64, crc32 of its decompressed bytes uint32);
* a footer of 24 bytes: documents uint64, frames uint32, crc32 of the table uint32, magic "LDSTIDS1".

A reader fetches the footer, the table and only those frames that hold requested documents.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, ship, with_text
from lodestone.llm.textkit import blocks, lean
from lodestone.llm.wordcache import encoder

MAGIC, SKIPPABLE, FOOTER = b"LDSTIDS1", 0x184D2A5E, struct.Struct("<QII8s")
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("start", "<u8"), ("n", "<u8")])
FRAME = np.dtype([("offset", "<u8"), ("size", "<u8"), ("ids", "<u8"), ("crc", "<u4")])
FRAME_IDS = 1 << 16
#: Stands for a null doc_id, which sorts before all others.
NO_ID = -(1 << 63)


class Writer:
    def __init__(self, out: BinaryIO, frame_ids: int = FRAME_IDS, level: int = 3):
        self.out, self.frame_ids = out, frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.docs: list[tuple[int, int, int, int, int]] = []
        self.frames: list[tuple[int, int, int, int]] = []
        self.parts: list[bytes] = []
        self.held = self.at = self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: unsigned 16-bit, little-endian."""
        n = len(ids) // 2
        self.docs.append((NO_ID if doc_id is None else doc_id, doc_id is None, len(self.frames), self.held, n))
        self.parts.append(ids)
        self.held += n
        self.total += n
        if self.held >= self.frame_ids:
            self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.parts)
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.frames.append((self.at, len(packed), self.held, zlib.crc32(raw)))
        self.at += len(packed)
        self.parts, self.held = [], 0

    def close(self) -> None:
        if self.parts:
            self._flush()
        table = np.array(self.docs, DOC).tobytes() + np.array(self.frames, FRAME).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + FOOTER.size))
        self.out.write(table + FOOTER.pack(len(self.docs), len(self.frames), zlib.crc32(table), MAGIC))


class Reader:
    """Random access: only the frames of the documents asked for are read and decompressed."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        n_docs, n_frames, crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        length = n_docs * DOC.itemsize + n_frames * FRAME.itemsize
        source.seek(size - FOOTER.size - length)
        table = source.read(length)
        if zlib.crc32(table) != crc:
            raise ValueError("damaged seek table")
        self.docs = np.frombuffer(table, DOC, n_docs)
        self.frames = np.frombuffer(table, FRAME, n_frames, n_docs * DOC.itemsize)
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        f = self.frames[k]
        self.source.seek(int(f["offset"]))
        raw = self.unpack.decompress(self.source.read(int(f["size"])), max_output_size=int(f["ids"]) * 2 or 1)
        if zlib.crc32(raw) != f["crc"] or len(raw) != 2 * f["ids"]:
            raise ValueError(f"damaged frame {k}")
        return raw

    def read(self, rows: Iterable[int]) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) of the documents at these rows of the table; a frame is read once for a run of rows in it."""
        have, raw = -1, b""
        for i in rows:
            doc_id, null, k, start, n = self.docs[i].item()
            if k != have:
                have, raw = k, self.frame(k)
            yield None if null else doc_id, raw[2 * start : 2 * (start + n)]

    def find(self, doc_ids: Iterable[int]) -> list[int]:
        """Rows of the documents with these ids; the table is in ascending doc_id order."""
        keys = self.docs["doc_id"]
        return [i for d in doc_ids for i in range(int(np.searchsorted(keys, d)), int(np.searchsorted(keys, d, "right")))]


def write_token_files(spark: SparkSession, docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """Write `docs` (doc_id, text) to token files in `folder`, in ascending doc_id order over files and within them.

    Returns one row per file: part int, path string, n_docs long, n_ids long. Null texts are empty documents (the end id
    alone); repeated doc_ids are all kept, side by side; null doc_ids are kept and come first; an empty table gives no file. Files are
    written under a name of their own and then renamed, so a task that runs twice leaves one of its files referenced.
    """
    ship(spark)
    end = np.array([end_id], "<u2").tobytes()
    base = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        words, writer, first, name = encoder(tokenizer_path), None, None, f"{uuid.uuid4().hex}.ids.zst"
        sink = None
        for b in (x for batch in batches for x in blocks(batch, "text")):
            for doc_id, ids in zip(b.column(0).to_pylist(), words.texts(b.column(1).to_pylist()), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/_{name}", compression=None)
                    writer, first = Writer(sink), NO_ID if doc_id is None else doc_id
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(f"{root}/_{name}", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"first_id": [first], "path": [f"{base}/{name}"], "n_docs": [len(writer.docs)], "n_ids": [writer.total]})

    rows = with_text(docs)
    parts = partitions or spark.sparkContext.getConf().get("spark.lodestone.tokenFiles") or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id").mapInArrow(lean(write, "words"), "first_id long, path string, n_docs long, n_ids long")


def read_token_files(files: DataFrame) -> DataFrame:
    """Read files back: (path string, base long) -> doc_id, start (base added), ids binary (unsigned 16-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as source:
                    reader = Reader(source, source.size())
                    ids, starts, held, out = [], [], 0, []
                    for doc_id, raw in reader.read(range(len(reader.docs))):
                        ids.append(doc_id)
                        starts.append(base)
                        out.append(raw)
                        base += len(raw) // 2
                        held += len(raw)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": starts, "ids": pa.array(out, pa.binary())})
                            ids, starts, held, out = [], [], 0, []
                    if ids:
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": starts, "ids": pa.array(out, pa.binary())})

    return files.select("path", "base").mapInArrow(lean(read), "doc_id long, start long, ids binary")


def ids_digest(frame: DataFrame) -> DataFrame:
    """(doc_id, start, ids) -> doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = b.column("ids").to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "start": b.column("start"), "n_tokens": pa.array([len(x) // 2 for x in raws], pa.int64()), "ids_crc32": pa.array([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in raws], pa.int64())})

    return frame.mapInArrow(lean(digest), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_roundtrip(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write token files to the shared folder and read every document back with its place in the whole order."""
    scratch = Scratch(spark, "token-files")
    files = scratch.write(write_token_files(spark, docs, scratch.path("ids"), tokenizer_path), "manifest")
    # One row per file: few thousand at any size, so their running sum is taken on the driver.
    base, listed = 0, []
    for r in sorted(files.collect(), key=lambda r: r.first_id):
        listed.append((r.path, base))
        base += r.n_ids
    placed = spark.createDataFrame(listed, "path string, base long")
    return ids_digest(read_token_files(placed.repartition(max(1, len(listed)))))
