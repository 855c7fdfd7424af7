"""Removal of word windows that occur more than once in a corpus, by FM-indexes of shards.

A window of WINDOW words is routed by its anchor: the smallest hash of its runs of ANCHOR words. Equal windows have equal
anchors, so a shard that holds all windows of its anchors decides on them alone; nothing is compared across shards.
Neighbouring windows with one anchor form a run, which is kept as one word sequence.

1. Runs are counted by anchor (summed within tasks first). Anchors met once are done: their windows occur once.
2. Runs with equal words become one sequence, with their number as its weight. Its words are fetched from one document only,
   so a passage in a third of all rows is one sequence.
3. Sequences go to shards by anchor. Where an anchor has more than HOT different sequences (edges of a passage in
   many contexts), its windows are cut out, equal ones become one with a weight, and go to shards by their own hash.
4. A task's sequences come sorted by key, and are cut at borders of keys into shards of about SHARD_WORDS words. Each shard
   builds a compressed FM-index over its sequences and streams them through it: backward search over the wavelet matrix
   gives matching statistics; intervals of WINDOW words or more whose places weigh two or more are reported.
5. Intervals return to all runs with those words, and documents that have any are rewritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, ship, with_text
from lodestone.llm.fm_index import repeated_windows
from lodestone.llm.textkit import U, _power, blocks, gram_hashes, inside, joined, lean, mix, sliding_min, span_hashes, text_buffer, word_spans

WINDOW, ANCHOR = 35, 8
#: Windows of a run: with more, the anchor stands in it twice.
RUN = WINDOW - ANCHOR + 1
HOT = 500
SHARD_WORDS = 400_000
#: Stands for a null doc_id. A document is known by this and the hash of its words, so a real doc_id of that value does no harm.
NO_ID = -(1 << 63)
BROADCAST_IDS = 2_000_000


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = text_buffer(texts)
    starts, ends, woffs = word_spans(data, offs)
    return span_hashes(data, starts, ends), woffs


def marks(words: np.ndarray, woffs: np.ndarray) -> np.ndarray:
    """64-bit keys of texts, which tell rows that repeat a doc_id, or have none, apart."""
    total = np.concatenate(([U(0)], np.cumsum(words * _power("up", len(words)), dtype=U)))
    own = (total[woffs[1:]] - total[woffs[:-1]]) * _power("down", len(words) + 1)[woffs[:-1]]
    return mix(own).view(np.int64)


def runs_of(docs: DataFrame) -> DataFrame:
    """doc_id, mark, anchor, content, start, n, weight (2: equal windows within the run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                words, woffs = hashed_words(b.column(1))
                at, rows = inside(woffs, WINDOW)
                if not len(at):
                    continue
                anchor = sliding_min(gram_hashes(words, ANCHOR), RUN)[at]
                heads = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])))
                first = np.flatnonzero(heads)
                since = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                first = np.flatnonzero(since % RUN == 0)
                n = np.diff(np.append(first, len(at)))
                start = at[first]
                total = np.concatenate(([U(0)], np.cumsum(words * _power("up", len(words)), dtype=U)))
                content = mix((total[start + n + WINDOW - 1] - total[start]) * _power("down", len(words) + 1)[start] + n.astype(U))
                # Equal windows of one run stand less than RUN apart.
                whole = joined(gram_hashes(words, WINDOW), U(1))[at]
                twice = np.zeros(len(at), bool)
                which = np.repeat(np.arange(len(first)), n)
                for d in range(1, min(RUN, len(at))):
                    hit = np.flatnonzero(whole[d:] == whole[:-d])
                    twice[hit[which[hit] == which[hit + d]]] = True
                weight = 1 + np.maximum.reduceat(twice, first).astype(np.int32)
                row = rows[first]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array(marks(words, woffs)[row]), pa.array(anchor[first].view(np.int64)), pa.array(content.view(np.int64)), pa.array((start - woffs[:-1][row]).astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(weight)],
                    ["doc_id", "mark", "anchor", "content", "start", "n", "weight"],
                )

    return docs.mapInArrow(lean(run), "doc_id long, mark long, anchor long, content long, start int, n short, weight int")


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_words, sha of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                words, woffs = hashed_words(b.column(1))
                sha = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks(words, woffs)), pa.array(np.diff(woffs)), pa.array(sha)], ["doc_id", "mark", "n_words", "kept_sha256"])

    return docs.mapInArrow(lean(run), "doc_id long, mark long, n_words long, kept_sha256 string")


def with_mark(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks(*hashed_words(b.column(1)))), b.column(1)], ["doc_id", "mark", "text"])

    return docs.mapInArrow(lean(run), "doc_id long, mark long, text string")


def known(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, mark, ...) with the texts of those documents, whose doc_ids are known ones."""
    ids = wanted.select("doc_id").distinct()
    small = ids.count() <= BROADCAST_IDS
    some = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    return with_mark(some.select("doc_id", "text")).dropDuplicates(["doc_id", "mark"]).join(wanted, ["doc_id", "mark"])


def sequences(found: DataFrame, hot: bool) -> DataFrame:
    """(text, runs array<struct<anchor, content, start, n>>) -> anchor, content, key, off, n, words: one row for a run, or
    where hot one for each window of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                words, woffs = hashed_words(b.column(b.schema.get_field_index("text")))
                lists = b.column(b.schema.get_field_index("runs"))
                if isinstance(lists, pa.ChunkedArray):
                    lists = lists.combine_chunks()
                flat = lists.flatten()
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                anchor, content = (flat.field(c).to_numpy() for c in ("anchor", "content"))
                start, n = woffs[:-1][row] + flat.field("start").to_numpy(), flat.field("n").to_numpy().astype(np.int64)
                if hot:
                    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    start, anchor, content = np.repeat(start, n) + off, np.repeat(anchor, n), np.repeat(content, n)
                    key, n = joined(gram_hashes(words, WINDOW), U(1))[start].view(np.int64) if len(start) else content, np.ones(len(start), np.int64)
                else:
                    off, key = np.zeros(len(start), np.int64), anchor
                raw = words.astype("<u8").tobytes()
                for i in range(0, len(start), 20_000):
                    j = slice(i, i + 20_000)
                    seq = [raw[8 * a : 8 * z] for a, z in zip(start[j].tolist(), (start[j] + n[j] + WINDOW - 1).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x[j]) for x in (anchor, content, key, off, n)] + [pa.array(seq, pa.binary())], ["anchor", "content", "key", "off", "n", "words"])

    return found.select("text", "runs").mapInArrow(lean(run), "anchor long, content long, key long, off long, n long, words binary")


def search_shard(table: pa.Table) -> pa.RecordBatch:
    """key, content, first, last: intervals of windows that occur twice among the weighted sequences of a shard."""
    table = table.combine_chunks()
    key, content, n, count = (table.column(c).to_numpy() for c in ("key", "content", "n", "count"))
    raw, offs = text_buffer(table.column("words").chunk(0))
    sizes = np.diff(offs) // 8
    symbols = np.unique(raw.view("<u8") if len(raw) else np.zeros(0, "<u8"), return_inverse=True)[1].astype(np.int32) + 1
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    text = np.zeros(int((sizes + 1).sum()), np.int32)
    text[np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols
    del symbols
    seq, win = repeated_windows(text, starts, n, WINDOW, count)
    heads = np.flatnonzero(np.concatenate(([True], (seq[1:] != seq[:-1]) | (win[1:] != win[:-1] + 1)))) if len(seq) else np.zeros(0, np.int64)
    tails = np.append(heads[1:], len(seq))[: len(heads)] - 1
    return pa.RecordBatch.from_arrays([pa.array(key[seq[heads]]), pa.array(content[seq[heads]]), pa.array(win[heads]), pa.array(win[tails])], ["key", "content", "first", "last"])


def search_shards(sequences: DataFrame) -> DataFrame:
    """(key, content, n, count, words), those of a key side by side -> key, content, first, last: windows that occur twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, last = [], 0, None
        for b in batches:
            while b.num_rows:
                key, n = b.column("key").to_numpy(), b.column("n").to_numpy()
                size = np.cumsum(n + WINDOW - 1)
                # The first border of keys once the shard is full.
                full = (words + size - (n + WINDOW - 1) >= SHARD_WORDS) & np.concatenate(([key[0] != last], key[1:] != key[:-1]))
                k = int(np.argmax(full)) if full.any() else b.num_rows
                if k:
                    held.append(b.slice(0, k))
                    words, last = words + int(size[k - 1]), key[k - 1]
                if k < b.num_rows:
                    yield search_shard(pa.Table.from_batches(held))
                    held, words = [], 0
                b = b.slice(k)
        if held:
            yield search_shard(pa.Table.from_batches(held))

    return sequences.select("key", "content", "n", "count", "words").mapInArrow(lean(run), "key long, content long, first long, last long")


def repeated_spans(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows: (doc_id, text) -> doc_id (NO_ID for null), mark, spans array<struct<start, end>>: words covered by repeated windows."""
    rows = known(rows)
    runs = scratch.write(runs_of(rows), "runs")
    # Written, so that Spark can split the join of an anchor that very many runs share.
    anchors = scratch.write(runs.groupBy("anchor").agg(F.sum("weight").alias("met")).where("met > 1").select("anchor"), "anchors")
    again = scratch.write(runs.join(anchors, "anchor"), "again")
    scratch.drop("runs", "anchors")
    scratch.settle()
    one = again.groupBy("anchor", "content").agg(F.count("*").alias("count"), F.min(F.struct("doc_id", "mark", "start", "n")).alias("at")).select("anchor", "content", "count", "at.*")
    one = scratch.write(one, "sequences")
    varied = one.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("anchor", F.lit(True).alias("hot"))
    one = one.join(varied, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    grouped = scratch.write(
        one.groupBy("doc_id", "mark").agg(F.collect_list(F.when(~F.col("hot"), F.struct("anchor", "content", "start", "n"))).alias("runs"), F.collect_list(F.when(F.col("hot"), F.struct("anchor", "content", "start", "n"))).alias("hot_runs")), "wanted"
    )
    found = scratch.write(fetch(rows, grouped), "texts")
    scratch.settle()
    plain = sequences(found.where("size(runs) > 0"), False).join(one.select("anchor", "content", "count"), ["anchor", "content"]).select("key", "content", "n", "count", "words")
    windows = sequences(found.where("size(hot_runs) > 0").select("text", F.col("hot_runs").alias("runs")), True)
    hot = windows.join(one.select("anchor", "content", "count"), ["anchor", "content"])
    hot = hot.groupBy("key").agg(F.sum("count").alias("count"), F.first("words").alias("words")).select("key", F.col("key").alias("content"), F.lit(1).cast("long").alias("n"), "count", "words")
    size = one.agg(F.sum(F.col("n") + WINDOW)).first()[0] or 0
    tasks = max(1, int(size // (4 * SHARD_WORDS)) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    said = scratch.write(search_shards(plain.unionByName(hot).repartition(tasks, "key").sortWithinPartitions("key")), "said")
    scratch.settle()
    # Back to the runs: those of hot anchors by their windows' keys.
    places = windows.select("key", "anchor", F.col("content").alias("run"), "off").join(said.where("key = content").select("key"), "key", "left_semi")
    spans = said.select(F.col("key").alias("anchor"), "content", "first", "last").unionByName(places.select("anchor", F.col("run").alias("content"), F.col("off").alias("first"), F.col("off").alias("last")))
    hit = again.join(spans, ["anchor", "content"]).select("doc_id", "mark", (F.col("start") + F.col("first")).cast("long").alias("start"), (F.col("start") + F.col("last") + WINDOW).cast("long").alias("end"))
    spans = scratch.write(hit.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    scratch.drop("again", "sequences", "wanted", "texts", "said")
    return spans


def drop_spans(spark: SparkSession, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`docs` with the words of `spans` gone from text (n_chars follows, if there is such a column); all rows stay.

    Texts without spans are left as they are and aren't shuffled.
    """
    ids = spans.select(F.col("doc_id").alias("_known")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    spans = spans.withColumnRenamed("doc_id", "_known")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                yield b.append_column("mark", pa.array(marks(*hashed_words(b.column(b.schema.get_field_index("text"))))))

    names = list(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            new = [t if s is None else kept_words(t, s)[0] for t, s in zip(texts, b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else b.column(c) for c in names], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.withColumn("_known", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    touched = rows.join(ids, "_known", "left_semi").select(*docs.columns).mapInArrow(lean(mark), f"{schema}, mark long")
    touched = touched.withColumn("_known", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).join(spans, ["_known", "mark"], "left")
    out = rows.join(ids, "_known", "left_anti").select(*docs.columns).unionByName(touched.select(*docs.columns, "spans").mapInArrow(lean(cut), schema))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def kept_words(text: str | None, spans: list[dict]) -> tuple[str, int]:
    """The words outside all spans, joined by one space, and how many others there are."""
    words = (text or "").encode().split()
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, [s["start"] for s in spans], 1)
    np.add.at(gone, [s["end"] for s in spans], -1)
    stay = np.cumsum(gone)[:-1] == 0
    return b" ".join([words[i] for i in np.flatnonzero(stay).tolist()]).decode(), int(len(words) - stay.sum())


def without_spans(found: DataFrame) -> DataFrame:
    """(doc_id, mark, text, spans) -> doc_id, mark, kept string (kept words joined by one space), n_removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed = [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                left, n = kept_words(text, spans)
                kept.append(left)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(kept, pa.string()), pa.array(removed, pa.int64())], ["doc_id", "mark", "kept", "n_removed"])

    return found.select("doc_id", "mark", "text", "spans").mapInArrow(lean(run), "doc_id long, mark long, kept string, n_removed long")


def dedup_texts(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id (NO_ID for null), mark, kept, n_removed of the documents that lose words (see `repeated_spans`)."""
    ship(spark)
    scratch = scratch or Scratch(spark, "substring-dedup")
    rows = with_text(docs)
    return without_spans(fetch(known(rows), repeated_spans(spark, rows, scratch)))


def dedup_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of `docs` (doc_id, text).

    Null texts have no words; texts shorter than a window lose nothing; rows that repeat a text lose its windows each;
    rows that repeat a doc_id with another text, or have a null doc_id, are told apart by their words; further columns are
    ignored; an empty table gives no rows.
    """
    ship(spark)
    changed = dedup_texts(spark, docs).select(F.col("doc_id").alias("known"), "mark", "n_removed", F.sha2("kept", 256).alias("sha"))
    return (
        marked(with_text(docs))
        .withColumn("known", F.coalesce("doc_id", F.lit(NO_ID)))
        .join(changed, ["known", "mark"], "left")
        .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"))
    )
