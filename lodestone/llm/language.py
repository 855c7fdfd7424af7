"""Language identification by bit-sliced Bloom filters over n-grams.

Arrays of slots serve all languages, 63 of them each: bit L of a slot belongs to language L's filter. An n-gram's slots, and-ed, give
all languages that contain it in one lookup. A text's n-grams are counted for each language (a popcount for each bit),
the counts are corrected by each filter's false-positive rate, and the language that holds the largest share wins.

N-grams are runs of GRAM bytes of the A-Z lower-cased text, so they are 32-bit integers. The filters have SLOTS_A_GRAM
slots for each n-gram in them, within SLOTS; the counts that decide which n-grams enter cover every learning document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, only, ship
from lodestone.llm.textkit import blocks, lean, mix, text_buffer

GRAM, HASHES = 4, 3
#: Slots for each n-gram of the filters, and the fewest and most slots (powers of two; the most bounds what is broadcast).
SLOTS_A_GRAM, SLOTS = 8, (1 << 16, 1 << 24)
#: An n-gram enters a language's filter if it is found this often there, and at this share of its highest rate anywhere.
MIN_COUNT, MIN_RATE = 3, 0.1
#: Bytes of text that a worker looks at together: arrays of every byte's n-gram and slots are made of them.
BLOCK = 1 << 19
#: Language bits of a slot's word.
WORD = 63
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[9:14] = 32


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams inside rows, and for each row the index of its first one (one more at the end)."""
    low = LOWER[data].astype(np.uint32)
    n = len(low)
    if n < GRAM:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    all_ = low[: n - 3] | low[1 : n - 2] << np.uint32(8) | low[2 : n - 1] << np.uint32(16) | low[3:] << np.uint32(24)
    ok = np.ones(len(all_), bool)
    for k in range(1, GRAM):  # those that cross into the next row
        at = offs[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    counts = np.maximum(np.diff(offs) - GRAM + 1, 0)
    return all_[ok], np.concatenate(([0], np.cumsum(counts)))


def slots_of(g: np.ndarray, slots: int, hashes: int) -> Iterator[np.ndarray]:
    h = mix(g.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    for k in range(hashes):
        yield ((h >> np.uint64(20 * k)) & np.uint64(slots - 1)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, text) -> lang, gram, n: counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def fold(lang: str) -> None:
            g = np.concatenate([x for x, _ in held[lang]])
            n = np.concatenate([y for _, y in held[lang]])
            u, at = np.unique(g, return_inverse=True)
            held[lang] = [(u, np.bincount(at, n, len(u)).astype(np.int64))]

        for batch in batches:
            for b in blocks(batch, "text", BLOCK):
                data, offs = text_buffer(b.column(1))
                g, first = grams(data, offs)
                langs, which = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
                owner = np.repeat(which, np.diff(first))
                for k, lang in enumerate(langs.tolist()):
                    own = g if len(langs) == 1 else g[owner == k]
                    if len(own):
                        held.setdefault(lang, []).append(np.unique(own, return_counts=True))
                        if len(held[lang]) > 8:
                            fold(lang)
        for lang in list(held):
            fold(lang)
            u, n = held[lang][0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u)), pa.array(u.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return docs.mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(spark: SparkSession, docs: DataFrame, slots: int | None = None, hashes: int = HASHES) -> tuple[list[str], np.ndarray]:
    """Languages (ascending) and filters (a row of slots for each WORD languages), from `docs` (lang, text).

    Rows without a lang or text aren't learned from. One row for each filled slot comes to the driver. No learning rows give
    no languages.
    """
    ship(spark)
    rows = only(docs, "lang", "text").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = gram_counts(rows)
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())  # one row for a language
    bits = spark.createDataFrame([(x, k // WORD, 1 << k % WORD) for k, x in enumerate(langs)], "lang string, word int, bit long")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).join(F.broadcast(bits), "lang")
    rated = counts.join(F.broadcast(totals), "lang").select("gram", "word", "bit", "n", (F.col("n") / F.col("total")).alias("rate"))
    each = rated.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("word", "bit", "n", "rate")).alias("all")).select("gram", F.filter("all", lambda x: (x["n"] >= MIN_COUNT) & (x["rate"] >= F.lit(MIN_RATE) * F.col("best"))).alias("own")).where("size(own) > 0")
    scratch = Scratch(spark, "language")
    kept = scratch.write(each.select("gram", F.explode("own").alias("x")).groupBy("gram", F.col("x.word").alias("word")).agg(F.bit_or("x.bit").alias("mask")), "filters")
    if slots is None:
        slots = max(SLOTS[0], min(SLOTS[1], 1 << (SLOTS_A_GRAM * kept.count() - 1).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = b.column(0).to_numpy()
            for s in slots_of(g, slots, hashes):
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s.astype(np.int32)), b.column(2)], ["word", "slot", "mask"])

    filled = kept.select("gram", "word", "mask").mapInArrow(lean(place), "word int, slot int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    scratch.drop("filters")
    kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(len(langs), WORD) <= n)
    table = np.zeros((-(-len(langs) // WORD), slots), kind)
    table[filled.column("word").to_numpy(), filled.column("slot").to_numpy()] = filled.column("mask").to_numpy().astype(kind)
    return langs, table


def identify(spark: SparkSession, docs: DataFrame, langs: list[str], table: np.ndarray, hashes: int = HASHES) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), lang_pred, score, coverage for every row of `docs` (doc_id, text).

    score: the winner's share of all languages' corrected counts; coverage: of the text's n-grams. Null texts and texts
    without a letter are `und` with score 0; texts too short for an n-gram, or that no filter knows, get the first
    language with score 0; ties go to the first language in ascending order. Every row gives one row.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast(table)
    slots = table.shape[1]
    fill = [float(np.count_nonzero(table[k // WORD] & table.dtype.type(1 << k % WORD))) / slots for k in range(len(langs))]
    false = np.array([f**hashes for f in fill])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            for b in blocks(batch, "text", BLOCK):
                data, offs = text_buffer(b.column(1))
                g, first = grams(data, offs)
                places = list(slots_of(g, slots, hashes))
                total = np.diff(first)
                share = np.zeros((len(langs), b.num_rows))
                cover = np.zeros((len(langs), b.num_rows))
                for k in range(len(langs)):
                    if k % WORD == 0:
                        mask = np.bitwise_and.reduce([filters[k // WORD][s] for s in places])
                    found = np.concatenate(([0], np.cumsum((mask >> mask.dtype.type(k % WORD)) & mask.dtype.type(1), dtype=np.int64)))
                    hits = found[first[1:]] - found[first[:-1]]
                    share[k] = np.maximum(hits - false[k] * total, 0) / (1 - min(false[k], 0.999))
                    cover[k] = np.clip(share[k] / np.maximum(total, 1), 0, 1)
                texts = b.column(1).to_pylist()
                letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
                if not langs:
                    pred, score, coverage = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
                else:
                    pred = share.argmax(0)
                    best = share.max(0)
                    score = np.where(letters, best / np.maximum(share.sum(0), 1e-9), 0.0)
                    coverage = np.where(letters, cover.max(0), 0.0)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text_key": b.column(2), "lang_pred": [langs[p] if ok and langs else "und" for p, ok in zip(pred.tolist(), letters.tolist(), strict=True)], "score": pa.array(np.clip(score, 0, 1)), "coverage": pa.array(coverage)})

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(lean(run), "doc_id long, text_key long, lang_pred string, score double, coverage double")


def language_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learn from documents whose crc32(doc_id) mod 5 isn't 0, predict all."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    langs, table = learn(spark, docs.where(~held_out))
    return identify(spark, docs, langs, table).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "coverage")
