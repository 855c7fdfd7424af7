"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are runs of 4, 5 and 6 characters of the lower-cased text (white space counts as spaces), hashed to SLOTS slots; a
text has the features "at least once", "at least twice" and "at least four times" of a slot. Features are scaled by
r = log((p + 1) / |p + 1|) - log((q + 1) / |q + 1|), p and q being the numbers of toxic and other learning documents with the
feature; logistic regression learns one weight for each.

The classifier is fitted on SAMPLE learning rows at most (those with the smallest hash of doc_id among labelled rows whose
document has a text), as long as their texts together have SAMPLE_CHARS characters at most; of the features the KEPT with the largest log-likelihood ratio are used, if that is above MIN_GAIN. These bounds are
parameters. Scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import only, ship
from lodestone.llm.textkit import blocks, lean

SIZES, LEVELS, SLOTS = (4, 5, 6), (1, 2, 4), 1 << 21
FEATURES = SLOTS * len(LEVELS)
SAMPLE, SAMPLE_CHARS, KEPT = 20_000, 60_000_000, 20_000
MIN_DOCS, MIN_GAIN = 4, 7.0
L2 = 1.0
THRESHOLD = 0.7


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, white space as spaces, and row offsets; nulls are empty."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    points = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le"), np.uint32).copy()
    points[(points >= 9) & (points <= 13)] = 32
    return points, np.concatenate(([0], np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False), dtype=np.int64)))


def slots(points: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: slots of all positions, and rows of those positions (-1 where it crosses rows)."""
    n = len(points)
    rows = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    value = np.zeros(n, np.uint64)
    for size in range(1, max(SIZES) + 1):
        if n < size:
            return
        value = value[: n - size + 1] * np.uint64(0x100000001B3) + points[size - 1 :]
        if size in SIZES:
            mixed = (value + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            first = rows[: n - size + 1]
            yield (mixed >> np.uint64(43)).astype(np.int32), np.where(first == rows[size - 1 :], first, -1)


def distinct_features(texts: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, sorted; table (slot, level) maps slots and levels to features (-1: none)."""
    used = None if table is None else (table >= 0).any(1)
    found = []
    for slot, row in slots(*characters(texts)):
        ok = row >= 0 if used is None else (row >= 0) & used[slot]
        found.append(row[ok].astype(np.int64) << 32 | slot[ok])
    pairs, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    out = []
    for k, level in enumerate(LEVELS):
        enough = pairs[times >= level]
        slot = enough & 0xFFFFFFFF
        feature = slot * len(LEVELS) + k if table is None else table[slot, k].astype(np.int64)
        out.append((enough - slot | feature)[feature >= 0])
    both = np.sort(np.concatenate(out))
    return both >> 32, both & 0xFFFFFFFF


def fit(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, l2: float = L2, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on x = scale for each feature of a row, by L-BFGS; (weights, bias)."""
    n, m, x = len(y), len(scale), scale[cols]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, x * w[cols], n) + w[m]
        err = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        value = float((np.logaddexp(0, z) - y * z).sum() + l2 / 2 * (w[:m] @ w[:m]))
        return value, np.append(np.bincount(cols, x * err[rows], m) + l2 * w[:m], err.sum())

    w = np.zeros(m + 1)
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, kept = grad.copy(), []
        for s, t in reversed(past):
            kept.append((s @ step) / (s @ t))
            step -= kept[-1] * t
        step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.linalg.norm(grad)))
        for (s, t), a in zip(past, reversed(kept), strict=True):
            step += (a - (t @ step) / (s @ t)) * s
        size, slope = 1.0, float(grad @ step)
        while True:
            new, (got, ahead) = w - size * step, loss(w - size * step)
            if got <= value - 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        if value - got <= 1e-9 * max(1.0, abs(value)):
            break
        if (new - w) @ (ahead - grad) > 1e-12:
            past = [*past[-9:], (new - w, ahead - grad)]
        w, value, grad = new, got, ahead
    return w[:m], float(w[m])


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, kept: int = KEPT) -> dict:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1; a doc_id with several rows is toxic if one says so).

    The sample is taken from the labels of documents with a text, so it can be broadcast, and only the sample's texts are shuffled; of a
    doc_id with several texts the first in order is learned from, so rows are bounded too. Without
    rows of both labels the model is the share of toxic rows; null texts and null labels aren't learned from.
    """
    ship(spark)
    marks = only(labels, "doc_id", "toxic").where("toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = only(docs, "doc_id", "text").where("text is not null")
    sizes = texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("size"))
    chosen = marks.join(sizes, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # `sample` rows at most
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_CHARS).select("doc_id", "toxic")
    some = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.col("text").cast("string")).alias("text")).select("doc_id", "text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FEATURES), np.int32)
        docs = [0, 0]
        for batch in batches:
            for b in blocks(batch, "text"):
                label = np.array(b.column(2).to_pylist(), bool)
                row, col = distinct_features(b.column(1))
                for k in (0, 1):
                    total[k] += np.bincount(col[label[row] == bool(k)], minlength=FEATURES).astype(np.int32)
                    docs[k] += int((label == bool(k)).sum())
        at = np.flatnonzero(total[0] + total[1])
        for i in range(0, len(at), 50_000):
            a = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(total[0][a].astype(np.int64)), pa.array(total[1][a].astype(np.int64))], ["slot", "q", "p"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([docs[0]], pa.int64()), pa.array([docs[1]], pa.int64())], ["slot", "q", "p"])

    sums = some.mapInArrow(lean(count), "slot int, q long, p long").groupBy("slot").agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
    table = sums.where(f"slot = -1 or p + q >= {MIN_DOCS}").toArrow()  # FEATURES rows at most
    slot, q, p = (table.column(c).to_numpy() for c in ("slot", "q", "p"))
    all_q, all_p = int(q[slot < 0].sum()), int(p[slot < 0].sum())
    if not all_q or not all_p:
        return {"slots": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": float(np.log((all_p + 1) / (all_q + 1)))}
    slot, q, p = slot[slot >= 0], q[slot >= 0].astype(float), p[slot >= 0].astype(float)
    share = (p + q) / (all_p + all_q)
    gain = p * np.log(np.maximum(p, 1e-9) / (all_p * share)) + q * np.log(np.maximum(q, 1e-9) / (all_q * share))
    best = np.lexsort((slot, -gain))[:kept]
    best = best[gain[best] > MIN_GAIN]
    slot, p, q = slot[best], p[best], q[best]
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    lookup = np.full((SLOTS, len(LEVELS)), -1, np.int32)
    lookup.reshape(-1)[slot] = np.arange(len(slot))
    shared = spark.sparkContext.broadcast(lookup)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                row, col = distinct_features(b.column(1), shared.value)
                at = np.searchsorted(row, np.arange(b.num_rows + 1))
                own = pa.LargeListArray.from_arrays(pa.array(at), pa.array(col.astype(np.int32))).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(2), own], ["toxic", "features"])

    got = some.mapInArrow(lean(features), "toxic int, features array<int>").toArrow()  # rows of the sample
    y = got.column("toxic").to_numpy().astype(float)
    lists = got.column("features").combine_chunks()
    cols = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), np.array([len(x) for x in lists]))
    w, bias = fit(row, cols, ratio, y)
    return {"slots": slot.astype(np.int64), "weights": w * ratio, "bias": bias}


def score(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score for every row of `docs` (doc_id, text); null or empty texts have no features."""
    ship(spark)
    lookup = np.full((SLOTS, len(LEVELS)), -1, np.int32)
    lookup.reshape(-1)[model["slots"]] = np.arange(len(model["slots"]))
    shared = spark.sparkContext.broadcast((lookup, np.asarray(model["weights"], float)))
    bias = model["bias"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights = shared.value
        for batch in batches:
            for b in blocks(batch, "text"):
                row, col = distinct_features(b.column(1), table)
                z = np.bincount(row, weights[col], b.num_rows) + bias if len(row) else np.full(b.num_rows, bias)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, score double")


def toxicity_query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = learn(spark, docs, labels.where(~held_out))
    return score(spark, docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
