"""Commit histories: sessions, hours, streaks, ownership. commits: (author, ts)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import round_half_up

GAP_MINUTES, LEAD_MINUTES, DAY_CAP_MINUTES = 120, 30, 720


def human_commits(commits: DataFrame, message: str = "message", parents: str = "n_parents", author: str = "author") -> DataFrame:
    """Without merges and bots."""
    return commits.where(~(F.col(message).startswith("Merge ") | (F.col(parents) > 1) | F.col(author).endswith("[bot]")))


def sessions(commits: DataFrame, gap: int = GAP_MINUTES, lead: int = LEAD_MINUTES) -> DataFrame:
    """author, start_ts, end_ts, commits, minutes: gaps of `gap` minutes or more end a session; its length is last - first
    plus `lead`. `session_window` would join a gap of exactly `gap` minutes, so gaps are marked and summed instead."""
    w = Window.partitionBy("author").orderBy("ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = commits.select("author", "ts", micros.alias("us")).withColumn("new", F.coalesce((F.col("us") - F.lag("us").over(w) >= gap * 60_000_000).cast("int"), F.lit(1)))
    rows = rows.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("author", "session").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("commits"), ((F.max("us") - F.min("us")) / 60_000_000 + lead).alias("minutes")).drop("session")


def cap_days(found: DataFrame, cap: int = DAY_CAP_MINUTES) -> DataFrame:
    """Sessions of days over the cap, scaled to it."""
    day = F.sum("minutes").over(Window.partitionBy("author", F.to_date("start_ts")))
    return found.withColumn("day_minutes", day).withColumn("minutes", F.when(F.col("day_minutes") > cap, F.col("minutes") * cap / F.col("day_minutes")).otherwise(F.col("minutes"))).drop("day_minutes")


def streaks(commits: DataFrame) -> DataFrame:
    """author, active_days, streak: days with commits, and the longest run of consecutive ones."""
    days = commits.select("author", F.to_date("ts").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("author").orderBy("day")))
    runs = days.withColumn("island", island).groupBy("author", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("author").agg(F.sum("n").alias("active_days"), F.max("n").alias("streak"))


def punch_card(found: DataFrame) -> DataFrame:
    """dow (Sunday 0), hour, sessions, minutes, by start."""
    return found.groupBy((F.dayofweek("start_ts") - 1).alias("dow"), F.hour("start_ts").alias("hour")).agg(F.count("*").alias("sessions"), F.sum("minutes").alias("minutes"))


def over_time(found: DataFrame, unit: str) -> DataFrame:
    """bucket, author, sessions, minutes; unit: day, week (from Monday) or month."""
    form = "yyyy-MM" if unit == "month" else "yyyy-MM-dd"
    return found.groupBy(F.date_format(F.date_trunc(unit, "start_ts"), form).alias("bucket"), "author").agg(F.count("*").alias("sessions"), F.sum("minutes").alias("minutes"))


def best_weekday(found: DataFrame) -> DataFrame:
    """author, dow with most minutes; ties go to the first from Sunday."""
    by = found.groupBy("author", (F.dayofweek("start_ts") - 1).alias("dow")).agg(F.sum("minutes").alias("minutes"))
    return by.groupBy("author").agg(F.max_by("dow", F.struct("minutes", -F.col("dow"))).alias("best_dow"))


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """(start_line, end_line, ...) -> one row for each line, with is_start."""
    return ranges.withColumn("line_no", F.explode(F.sequence("start_line", "end_line"))).withColumn("is_start", F.col("line_no") == F.col("start_line"))


def ownership(ranges: DataFrame, by: str = "author") -> DataFrame:
    """author, lines, pct (one decimal) of closed line ranges; null authors are Unknown."""
    lines = ranges.groupBy(F.coalesce(by, F.lit("Unknown")).alias("author")).agg(F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("lines"))
    total = lines.agg(F.sum("lines").alias("all"))
    return lines.join(F.broadcast(total)).select("author", "lines", round_half_up(F.col("lines") * 100.0 / F.col("all"), 1).alias("pct"))


def ranges_at(points: DataFrame, ranges: DataFrame, key: list[str], width: int = 64) -> DataFrame:
    """points (key, line_no) with the ranges (key, start_line, end_line, ...) that hold them: equi-join on buckets of
    `width` lines, then the exact test."""
    buckets = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))))
    return points.withColumn("_b", F.floor(F.col("line_no") / width)).join(buckets, [*key, "_b"]).where("line_no between start_line and end_line").drop("_b")


def first_known(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """key, value: the first that isn't null, by time."""
    return rows.groupBy(key).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(at))).alias(value))


PATCH = "hunk int, kind string, old_line int, new_line int, text string"


def patch_rows(patch: str) -> list[tuple]:
    """(hunk, kind, old_line, new_line, text) of a unified diff's lines; binary patches have none."""
    import re

    rows, hunk, old, new = [], -1, 0, 0
    if "Binary file" in patch:
        return rows
    for line in patch.split("\n"):
        if m := re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", line):
            hunk, old, new = hunk + 1, int(m[1]), int(m[2])
        elif hunk >= 0 and not line.startswith("\\"):
            kind = {"+": "add", "-": "del"}.get(line[:1], "context")
            rows.append((hunk, kind, None if kind == "add" else old, None if kind == "del" else new, line[1:]))
            old += kind != "add"
            new += kind != "del"
    return rows


def parse_patches(patches: DataFrame, key: str = "key", patch: str = "patch") -> DataFrame:
    """key, hunk, kind, old_line, new_line, text of every line of every patch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(k, *r) for k, p in zip(f["key"], f["patch"], strict=True) if p for r in patch_rows(p)]
            yield pd.DataFrame(out, columns=["key", "hunk", "kind", "old_line", "new_line", "text"]).astype({"old_line": "Int32", "new_line": "Int32"})

    return patches.select(F.col(key).cast("string").alias("key"), F.col(patch).alias("patch")).mapInPandas(run, f"key string, {PATCH}")


def since(ts: Column, now: Column) -> Column:
    """today, `n`d, `n`mo or `n`y."""
    d = F.datediff(now, ts)
    return F.when(d < 1, "today").when(d < 30, F.concat(d.cast("string"), F.lit("d"))).when(d < 365, F.concat(F.floor(d / 30).cast("string"), F.lit("mo"))).otherwise(F.concat(F.floor(d / 365).cast("string"), F.lit("y")))


DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def author_estimates(commits: DataFrame, gap: int = GAP_MINUTES, cap: int = DAY_CAP_MINUTES) -> DataFrame:
    """author, commits, sessions, minutes, active_days, per_day (minutes), best_day, streak of each author of (author, ts)."""
    found = cap_days(sessions(commits, gap), cap)
    total = found.groupBy("author").agg(F.sum("commits").alias("commits"), F.count("*").alias("sessions"), F.sum("minutes").alias("minutes"), F.countDistinct(F.to_date("start_ts")).alias("active_days"))
    starts = found.select("author", F.col("start_ts").alias("ts"))
    best = best_weekday(found).select("author", F.get(F.array(*map(F.lit, DAYS)), F.col("best_dow")).alias("best_day"))
    return total.withColumn("per_day", F.col("minutes") / F.col("active_days")).join(best, "author").join(streaks(starts).select("author", "streak"), "author")


def pulse(estimates: DataFrame) -> DataFrame:
    """One row: minutes, contributors, the most active days of one of them, minutes of a session."""
    return estimates.agg(F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("minutes"), F.count("*").alias("contributors"), F.coalesce(F.max("active_days"), F.lit(0)).alias("most_days"), F.coalesce(F.sum("minutes") / F.sum("sessions"), F.lit(0.0)).alias("session_minutes"))


def by_author(commits: DataFrame, most: int = 15) -> DataFrame:
    """author, n, place: the `most` authors with most commits, and one row for the rest."""
    counts = commits.groupBy("author").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "author").limit(most)
    rest = counts.join(F.broadcast(top.select("author")), "author", "left_anti").agg(F.count("*").alias("others"), F.sum("n").alias("n")).where("others > 0")
    return top.unionByName(rest.select(F.concat(F.lit("+"), F.col("others").cast("string"), F.lit(" more")).alias("author"), "n"))


def owners(ranges: DataFrame) -> DataFrame:
    """(start_line, end_line, author_name, author_email, author_login) -> email, name, login (the first known), lines, pct."""
    rows = ranges.select(F.coalesce("author_email", F.lit("unknown")).alias("email"), F.coalesce("author_name", F.lit("Unknown")).alias("name"), "author_login", "start_line", (F.col("end_line") - F.col("start_line") + 1).alias("n"))
    by = rows.groupBy("email").agg(F.min_by("name", "start_line").alias("name"), F.min_by(F.col("author_login"), F.when(F.col("author_login").isNotNull(), F.col("start_line"))).alias("login"), F.sum("n").cast("long").alias("lines"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("lines").alias("all")))).select("email", "name", "login", "lines", round_half_up(F.col("lines") * 100.0 / F.col("all"), 1).alias("pct"))  # one row
