"""Zip archives against the standard library's reading of the whole."""

import os
import random
import zipfile

from lodestone.sources import archives


def make(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, data, method in entries:
            z.writestr(zipfile.ZipInfo(name), data, method)


def brute(path, max_file, max_total):
    out, total = [], 0
    with zipfile.ZipFile(path) as z:
        for k, info in enumerate(z.infolist()):
            inner = info.filename.partition("/")[2]
            if info.is_dir() or not inner or ".." in inner.split("/") or inner.split("/")[-1].split(".")[-1].lower() not in archives.INDEXABLE or info.file_size > max_file:
                continue
            total += info.file_size
            if total > max_total:
                break
            out.append((os.path.basename(path), k, inner, z.read(info).decode("utf-8", "replace"), info.file_size))
    return out


def rows(df):
    return sorted((os.path.basename(r.archive), r.ordinal, r.path, r.content, r.size) for r in df.collect())


def test_caps_and_kinds(spark, tmp_path):
    draw = random.Random(4)
    text = lambda n: "".join(draw.choice("abc é\n") for _ in range(n))
    both = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)
    first = [(f"repo/src/{'d/' * (k % 3)}f{k}.{draw.choice(['ts', 'py', 'bin', 'JS'])}", text(draw.randrange(3000)), both[k % 2]) for k in range(200)]
    odd = [("repo/", "", both[0]), ("repo/dir/", "", both[0]), ("top.ts", "x", both[0]), ("repo/../a.ts", "x", both[0]), ("repo/dockerfile", "FROM x", both[1]), ("repo/bad.md", b"\xff\xfeok", both[0]), ("repo/long.ts", "y" * 9000, both[1]), ("repo/empty.py", "", both[0]), ("repo/twice.py", "1", both[0]), ("repo/twice.py", "2", both[0])]
    make(tmp_path / "a.zip", odd + first)
    make(tmp_path / "b.zip", first[:40])
    make(tmp_path / "none.zip", [])
    for max_file, max_total in ((5000, 10**9), (1500, 40_000), (10**6, 6)):
        got = archives.read_zip(spark, f"{tmp_path}/*.zip", maxFile=max_file, maxTotal=max_total, rangeBytes=20_000)
        assert rows(got) == sorted(r for n in ("a", "b", "none") for r in brute(str(tmp_path / f"{n}.zip"), max_file, max_total))
    assert archives.read_zip(spark, f"{tmp_path}/none.zip").count() == 0
    assert archives.read_zip(spark, f"{tmp_path}/no*where.zip").count() == 0


def test_a_large_archive_is_read_in_several_tasks(spark, tmp_path):
    # 70,000 entries need the long form of the list.
    path = str(tmp_path / "large.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for k in range(70_000):
            z.writestr(f"r/f{k}.ts", f"{k} " * 100)
    got = archives.read_zip(spark, path, rangeBytes=4 << 20)
    assert got.rdd.getNumPartitions() >= 8
    assert (got.count(), got.selectExpr("sum(size)").first()[0]) == (70_000, sum(len(f"{k} ") * 100 for k in range(70_000)))


def test_runs():
    assert archives.runs([], 10) == [] and archives.runs([50], 10) == [(0, 1)]
    assert archives.runs([4, 4, 4, 20, 1], 10) == [(0, 2), (2, 3), (3, 4), (4, 5)]
