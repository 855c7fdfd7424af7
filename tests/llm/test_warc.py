"""WARC files against the pages they were made of."""

import gzip
import hashlib
import os

import duckdb
import pytest
from lodestone.llm import warc
from lodestone.llm.common import Scratch
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, offset long, kind string"


@pytest.fixture(scope="module")
def pages(spark):
    copy, other = "<p>é copy</p>" * 100, "<b>other</b>" * 400
    rows = [(k, f"http://h{k % 3}.org/{k}", f"<h1>{k}</h1>" + "text " * (k * 37 % 900), k, "x") for k in range(0, 4000, 13)]
    rows += [(10**15 + k, None, copy, None, None) for k in range(40)]
    rows += [(-5, "http://a b\r\nX: y", other, 1, "x"), (7, "u", other, 1, "x"), (7, "u", other, 1, "x"), (None, "n", other, 1, "x"), (None, None, None, 1, "x"), (None, "n", "alone " * 400, 1, "x")]
    rows += [(8, "u", None, 1, "x"), (9, "u", "", 1, "x"), (11, "u", "s" * 999, 1, "x"), (12, "u", "s" * 999, 1, "x"), (14, "u", "s" * 1000, 1, "x"), (15, "u", "s" * 1000, 1, "x"), (16, "u", "y" * 3_000_000, 1, "x"), (-(1 << 62), "u", "far", 1, "x"), ((1 << 63) - 1, "u", "far", 1, "x")]
    return spark.createDataFrame(rows, PAGES)


def write(spark, pages, **more):
    scratch = Scratch(spark, "test-warc")
    folder = scratch.path("archives")
    manifest = warc.write_warc(spark, pages, folder, scratch, **more)
    local = folder.removeprefix("file://")
    return manifest, folder, {f: open(os.path.join(local, f), "rb").read() for f in os.listdir(local) if f.endswith(".gz")} if os.path.isdir(local) else {}


def want(rows):
    last = {}
    for r in rows:
        h = r.html or ""
        if len(h.encode()) >= 1000 and r.page_id is not None:
            last[h] = max(last.get(h, r.page_id), r.page_id)
    out = []
    for r in rows:
        h = r.html or ""
        refers = last.get(h) if h in last and (r.page_id is None or r.page_id < last[h]) else None
        out.append((r.page_id, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "response" if refers is None else "revisit", refers, None if refers is not None else h))
    return sorted(out, key=str)


def test_round_trip(spark, pages):
    manifest, folder, files = write(spark, pages, shard_bytes=40_000, file_bytes=1_500)
    back = warc.read_warc(spark, manifest, folder)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in back.collect()), key=str)
    assert got == want(pages.collect())
    listed = {r.name: r for r in manifest.collect()}
    assert set(listed) == set(files) and len(files) > 15 and max(r.roll for r in listed.values()) > 0
    for name, raw in files.items():
        assert hashlib.sha256(raw).hexdigest() == listed[name].sha256 and len(raw) == listed[name].bytes
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == listed[name].records + 1
    in_order = sorted(listed.values(), key=lambda r: (r.shard, r.roll))
    assert all(a.last_id is None or a.last_id <= b.first_id for a, b in zip(in_order, in_order[1:], strict=False))
    assert all(not r.bytes > 1_500 or r.records for r in in_order)


def test_same_files_however_dealt(spark, pages):
    one = write(spark, pages.coalesce(1), shard_bytes=40_000, file_bytes=1_500)[2]
    many = write(spark, pages.repartition(13, F.rand(3)), shard_bytes=40_000, file_bytes=1_500)[2]
    assert one == many


def test_commit_may_run_again(spark, pages):
    scratch = Scratch(spark, "test-commit")
    folder = scratch.path("archives")
    manifest = warc.write_warc(spark, pages, folder, scratch)
    first = sorted(manifest.collect())
    written = spark.read.schema(manifest.schema).parquet(scratch.path("written"))
    assert sorted(warc.commit(spark, written, folder, scratch).collect()) == first
    os.remove(folder.removeprefix("file://") + "/" + first[0].name)
    with pytest.raises(Exception, match="neither written nor committed"):
        warc.commit(spark, written, folder, scratch)


def test_heavy_slices_are_cut(spark):
    keys = spark.range(20_000).select(F.when(F.col("id") == 0, F.lit(-(1 << 61))).when(F.col("id") == 1, F.lit(1 << 61)).otherwise(F.col("id") + 10**12).alias("page_id"), F.lit(400).cast("long").alias("bytes"))
    cuts = warc.bounds(keys, 100_000)
    assert cuts == sorted(set(cuts)) and 190 <= len(cuts) <= 420
    sizes = [0] * (len(cuts) + 1)
    import bisect

    for r in keys.collect():
        sizes[bisect.bisect_right(cuts, r.page_id)] += 1000
    assert max(sizes) <= 100_000


def test_damage_is_found(spark):
    raw = warc.page_record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, 0)
    content = gzip.decompress(raw)
    assert warc.page_of(*warc.parse(content))[-1] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(content.replace(b"payload\r\n\r\n", b"paylaod\r\n\r\n"))


def test_empty(spark, pages):
    manifest, folder, files = write(spark, pages.where("page_id > 5 and page_id < 6"))
    assert manifest.count() == 0 and files == {}
    assert warc.read_warc(spark, manifest, folder).count() == 0


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    got = warc.warc_roundtrip(spark, spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(warc.WARC_SQL).fetchall(), key=str)
