"""Stateful scans against one scan of the last versions, over any split into batches."""

import random
import re

import pytest
from lodestone.operators.scan import Rule
from lodestone.streaming import rescan

RULES = [Rule("a", "aa", "info", "security"), Rule("b", "b+c", "info", "security", exclude="skip"), Rule("c", r"^c", "info", "security")]


def brute(changes):
    last = {}
    for path, version, content in changes:
        if path is not None and version is not None and (path not in last or version > last[path][0]):
            last[path] = (version, content)
    return sorted((p, r.id, i + 1) for p, (_, t) in last.items() for i, line in enumerate((t or "").split("\n")) for r in RULES if t is not None and re.search(r.pattern, line) and not (r.exclude and re.search(r.exclude, line)))


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_any_split_gives_one_scan(spark, tmp_path, batches):
    draw = random.Random(9)
    changes = [(f"p{draw.randrange(12)}", v, None if draw.random() < 0.15 else "".join(draw.choice("abc\n") for _ in range(draw.randrange(25)))) for v in range(1, 90)]
    changes += [("late", 5, "aa"), ("late", 3, "bc"), ("gone", 2, None), ("gone", 1, "aa"), (None, 1, "aa"), ("none", None, "aa"), ("same", 1, "aa"), ("same", 2, "aa")]
    draw.shuffle(changes)
    cut = sorted(draw.sample(range(1, len(changes)), batches - 1))
    for k, (a, z) in enumerate(zip([0, *cut], [*cut, len(changes)], strict=True)):
        spark.createDataFrame(changes[a:z], "path string, version long, content string").coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema("path string, version long, content string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    rows = rescan.run_to_end(spark, rescan.follow(stream, RULES), f"file://{tmp_path}/out")
    assert sorted(map(tuple, rescan.net(rows).select("path", "rule_id", "line_no").collect())) == brute(changes)
    assert rows.where("path = 'same'").count() == 1


def test_states_come_with_rows(spark, tmp_path):
    stream = spark.readStream.schema("path string, version long, content string").parquet(f"file://{tmp_path}")
    text = rescan.follow(stream, RULES)._jdf.queryExecution().analyzed().toString()
    # Each call for a state of its own is a round trip from Python for every path.
    assert "FlatMapGroupsInPandasWithState" in text and "TransformWithState" not in text
