"""Fuzzy subsequence scores, as a fold over the query's characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAKS = ("/", ".", "-", "_")


def fuzzy_match(query: str, text: Column) -> Column:
    """struct<ok, score, places>: greedy subsequence match. 10 for a match right after the last one (or at the start, for the first),
    else 1; 5 more at a start or after / . - _; 1 more for the same case; less one for every 20 characters of text. places are
    the positions from 0."""
    low = F.lower(text)
    start = F.struct(F.lit(True).alias("ok"), F.lit(0).alias("score"), F.lit(-1).alias("last"), F.array().cast("array<int>").alias("places"))

    def step(a: Column, q: Column) -> Column:
        i = F.position(F.lower(q), low, a["last"] + 2) - 1
        points = F.when(i == a["last"] + 1, 10).otherwise(1) + F.when((i == 0) | F.substring(text, i, F.lit(1)).isin(*BREAKS), 5).otherwise(0) + F.when(F.substring(text, i + 1, F.lit(1)) == q, 1).otherwise(0)
        found = F.struct(F.lit(True).alias("ok"), (a["score"] + points).alias("score"), i.alias("last"), F.concat(a["places"], F.array(i)).alias("places"))
        lost = F.struct(F.lit(False).alias("ok"), a["score"].alias("score"), a["last"].alias("last"), a["places"].alias("places"))
        return F.when(a["ok"] & (i >= 0), found).otherwise(lost)

    end = lambda a: F.struct(a["ok"].alias("ok"), (a["score"] - F.floor(F.length(text) / 20)).cast("int").alias("score"), a["places"].alias("places"))
    return F.aggregate(F.array(*map(F.lit, query)) if query else F.array().cast("array<string>"), start, step, end)


def fuzzy_column(query: str, text: Column) -> Column:
    """The score, or null where the query is no subsequence."""
    m = fuzzy_match(query, text)
    return F.when(m["ok"], m["score"])
