"""Self-join of documents by the Jaccard similarity of their word n-gram sets, vertically partitioned.

All n-grams have one global order: the most frequent come last, by count; the rest go by hash. A pair at the
threshold must share an n-gram in the first (1 - threshold) part of both sets, which gives candidates; lengths and the
places of the shared n-gram bound the overlap of each. Sets also have parity bitmaps, of two to four bits for an n-gram: two
bitmaps differ in no more places than the sets do, which rules out most candidates before their n-grams are fetched; of
two lengths, the longer one is folded. The order itself is then cut into FRAGMENTS (equal parts of its hashed n-grams, and
the frequent ones at its end), overlaps are counted for each fragment of a pair separately, and summed for each pair.

Documents with equal sets are one node. Links are needed for components only, so first every node of an n-gram's bucket is
compared with one hub of that bucket; components shrink, and what remains are pairs between different components, all of
which are compared. There a set meets only sets of the sizes that its place in the bucket allows, so documents of like size
that share a template, but too little of it, don't meet at all. Nothing is capped: an n-gram shared by a third of all rows
stands last in the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, ship, with_text
from lodestone.llm.components import components
from lodestone.llm.textkit import blocks, gram_hashes, inside, lean, mix, span_hashes, text_buffer, word_spans

WORDS, NUM, DEN = 5, 75, 100
FRAGMENTS = 8
#: Bits of the shortest and the longest bitmaps, powers of two. Larger sets have the longest, which bounds a batch.
BITS = (64, 1 << 17)
#: The order's tail: the HOT_KEPT most frequent n-grams. Those with hashes in the first FRONT of the hash range, where most prefixes
#: lie, are counted over all documents; of the others, those found HOT_LOCAL times or more in a chunk of CHUNK n-grams. They only
#: decide the order, which any value leaves correct.
FRONT, HOT_LOCAL, HOT_KEPT, CHUNK = 0.3, 3, 250_000, 2_000_000
#: Rows of a batch of counts.
EMITTED = 50_000
#: Document ids up to which a semi-join is broadcast; beyond, Spark shuffles both sides.
BROADCAST_IDS = 2_000_000
#: Further hubs of larger buckets, before all pairs that are left are compared. They only shrink what is left.
OTHER_HUBS = 2
#: Classes of sizes in a doubling.
SIZE_CLASSES = 8
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n-gram of words; a row with fewer words has its whole sequence as one."""
    data, offs = text_buffer(texts)
    data = LOWER[data]
    starts, ends, woffs = word_spans(data, offs)
    words = span_hashes(data, starts, ends)
    at, rows = inside(woffs, n)
    out_rows, out = [rows], [gram_hashes(words, n)[at] if len(at) else np.zeros(0, np.uint64)]
    counts = np.diff(woffs)
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            out_rows.append(short)
            out.append(mix(gram_hashes(words, k)[woffs[:-1][short]] + np.uint64(k)))
    return np.concatenate(out_rows), np.concatenate(out)


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), ordered by row and hash."""
    rows, h = shingles(texts)
    o = np.argsort(h)
    kind = np.uint16 if len(texts) <= 65536 else np.int64
    o = o[np.argsort(rows[o].astype(kind), kind="stable")]
    rows, h = rows[o], h[o]
    keep = np.ones(len(h), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    return rows[keep], h[keep]


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def hot_grams(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent n-grams, ascending, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            ok = (c >= HOT_LOCAL) | (u < np.uint64(FRONT * 2**64))
            u, c = u[ok], c[ok]
            for at in range(0, len(u), EMITTED):
                yield pa.RecordBatch.from_arrays([signed(u[at : at + EMITTED]), pa.array(c[at : at + EMITTED])], ["gram", "n"])

        for batch in batches:
            for b in blocks(batch, "text"):
                held.append(sets(b.column(1))[1])
                n += len(held[-1])
                if n >= CHUNK:
                    yield from emit()
                    held, n = [], 0
        if held:
            yield from emit()

    found = rows.mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LOCAL).orderBy(F.desc("n"), "gram").limit(HOT_KEPT).toArrow()
    grams, n = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
    o = np.argsort(grams)
    return grams[o], n[o]


def bitmaps(r: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity bitmaps of rows of n n-grams, given as (row, hash): the least power of two of 2 n bits or more, within BITS."""
    width = np.minimum(np.maximum(2 ** np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), BITS[0]), BITS[1])
    first = np.concatenate(([0], np.cumsum(width)))
    odd = np.bincount(first[r] + (h & (width[r] - 1).astype(np.uint64)).astype(np.int64), minlength=first[-1]) & 1
    raw = np.packbits(odd.astype(np.uint8)).tobytes()
    return pa.array([raw[a:z] for a, z in zip((first[:-1] // 8).tolist(), (first[1:] // 8).tolist(), strict=True)], pa.binary())


def apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many places each two bitmaps differ, the longer one folded to the length of the other."""
    lengths = np.array([[len(a), len(b)] for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(x), np.int64)
    for pair in np.unique(lengths, axis=0):
        at = np.flatnonzero((lengths == pair).all(1))
        sides = [np.frombuffer(b"".join([side[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1) for side in (x, y)]
        least = min(s.shape[1] for s in sides)
        a, b = (np.bitwise_xor.reduce(s.reshape(len(at), -1, least), axis=1) for s in sides)
        out[at] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return out


def prefixes(rows: DataFrame, hot: Broadcast) -> DataFrame:
    """doc_id, n, k1, k2, bits, prefix array<long>: set sizes, 128-bit set hashes, parity bitmaps, and the prefix in the
    global order.

    The prefix is given once for equal sets within a task; other rows have an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, freq = hot.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for b in blocks(batch, "text"):
                r, h = sets(b.column(1))
                n = np.bincount(r, minlength=b.num_rows)
                first = np.concatenate(([0], np.cumsum(n)))
                total = np.concatenate(([np.uint64(0)], np.cumsum(mix(h + np.uint64(0x243F6A8885A308D3)), dtype=np.uint64)))
                k1 = total[first[1:]] - total[first[:-1]]
                total = np.concatenate(([np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x13198A2E03707344)), dtype=np.uint64)))
                k2 = total[first[1:]] - total[first[:-1]]
                bits = bitmaps(r, h, n)
                if len(grams) and len(h):
                    at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
                    weight = np.where(grams[at] == h, freq[at], 0)
                    o = np.argsort(r.astype(np.int64) << 40 | np.minimum(weight, (1 << 40) - 1), kind="stable")
                    h = h[o]
                size = n - -(-n * NUM // DEN) + 1
                keys = list(zip(k1.tolist(), k2.tolist(), strict=True))
                lead = np.zeros(b.num_rows, bool)
                for i, k in enumerate(keys):
                    if n[i] and k not in seen:
                        seen.add(k)
                        lead[i] = True
                size = np.where(lead, size, 0)
                place = np.arange(len(h)) - first[:-1][r]
                chosen = h[place < size[r]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), signed(chosen))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), signed(k1), signed(k2), bits, lists], ["doc_id", "n", "k1", "k2", "bits", "prefix"])

    return rows.mapInArrow(lean(run), "doc_id long, n long, k1 long, k2 long, bits binary, prefix array<long>")


def bounded(nx: Column, ny: Column, px: Column, py: Column) -> Column:
    """Sizes, and the most that can be shared from these places on, allow the threshold."""
    nx, ny = nx.cast("long"), ny.cast("long")
    return (DEN * F.least(nx, ny) >= NUM * F.greatest(nx, ny)) & ((NUM + DEN) * F.least(nx - px, ny - py) >= NUM * (nx + ny))


def near_bitmaps(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """(x, y, nx, ny) of those whose bitmaps, (doc_id, bits), differ in no more places than two sets at the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differ = apart(b.column("x_bits").to_pylist(), b.column("y_bits").to_pylist())
            total = b.column("nx").to_numpy() + b.column("ny").to_numpy()
            yield b.select(["x", "y", "nx", "ny"]).filter(pa.array((NUM + DEN) * differ <= (DEN - NUM) * total))

    side = lambda c: bits.select(F.col("doc_id").alias(c), F.col("bits").alias(f"{c}_bits"))
    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "nx", "ny", "x_bits", "y_bits").mapInArrow(lean(test), "x long, y long, nx long, ny long")


def fragments(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The fragment of the global order in which each n-gram stands; hot (ascending) are the frequent ones."""
    part = ((h >> np.uint64(32)) * np.uint64(FRAGMENTS - 1) >> np.uint64(32)).astype(np.int64)
    if len(hot):
        part[hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h] = FRAGMENTS - 1
    return part


def overlaps(rows: DataFrame, pairs: DataFrame, hot: Broadcast, scratch: Scratch, name: str) -> DataFrame:
    """(x, y, nx, ny) -> (x, y) of those at the threshold, by overlaps counted in each fragment of the order."""
    ids = scratch.write(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct(), f"{name}-ids")
    few = ids.count() <= BROADCAST_IDS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                r, h = sets(b.column(1))
                key = r.astype(np.int64) * FRAGMENTS + fragments(h, hot.value[0])
                o = np.argsort(key, kind="stable")
                key, r, h = key[o], r[o], h[o]
                heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                stops = np.append(heads[1:], len(key))
                doc = b.column(0).to_numpy()
                raw = h.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(doc[r[heads]]), pa.array((key[heads] % FRAGMENTS).astype(np.int32)), pa.array([raw[8 * a : 8 * z] for a, z in zip(heads.tolist(), stops.tolist(), strict=True)], pa.binary())], ["doc_id", "fragment", "grams"])

    parts = scratch.write(rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(lean(cut), "doc_id long, fragment int, grams binary"), f"{name}-parts")
    side = lambda c: parts.select(F.col("doc_id").alias(c), "fragment", F.col("grams").alias(f"{c}_grams"))
    wide = pairs.select("x", "y").withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)))).join(side("x"), ["x", "fragment"]).join(side("y"), ["y", "fragment"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = [len(np.intersect1d(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8"), assume_unique=True)) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.int64())], ["x", "y", "shared"])

    partial = wide.select("x", "y", "x_grams", "y_grams").mapInArrow(lean(count), "x long, y long, shared long")
    summed = partial.groupBy("x", "y").agg(F.sum("shared").alias("shared"))
    return summed.join(pairs, ["x", "y"]).where((NUM + DEN) * F.col("shared") >= NUM * (F.col("nx") + F.col("ny"))).select("x", "y")


def join_components(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text).

    Null, empty and white-space texts have an empty set and are linked with nothing: their component is their own doc_id.
    Rows that repeat a doc_id with another text each keep their row and set size; the doc_id has one component, found by all
    of its texts. Rows with a null doc_id are documents of their own: their component is the smallest doc_id they are linked
    with, or null. Further columns are ignored; an empty table gives no rows.
    """
    ship(spark)
    scratch = scratch or Scratch(spark, "ngram-join")
    rows = with_text(docs)
    if unique_ids(rows):
        return _components(spark, rows, scratch)
    table = text_components(spark, rows, scratch)
    first = table.groupBy("component").agg(F.min("doc_id").alias("first"))
    table = scratch.write(table.join(first, "component").withColumn("start", F.coalesce("doc_id", "first")), "by-document")
    links = scratch.write(table.where("first <> doc_id").select(F.col("doc_id").alias("x"), F.col("first").alias("y")).distinct(), "documents")
    comps = components(scratch, links, "document-components").select(F.col("node").alias("start"), F.col("component").alias("end"))
    return table.join(comps, "start", "left").select("doc_id", "n_shingles", F.coalesce("end", "start").alias("component_id"))


def unique_ids(rows: DataFrame) -> bool:
    return rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def text_node() -> Column:
    """The node of a doc_id with one of its texts."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text").cast("string"))


def text_components(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, node, n_shingles, component (a node) of every row (doc_id, text), where rows of one doc_id with other texts
    are nodes of their own. Texts are shuffled to take equal rows once."""
    ship(spark)
    nodes = rows.select("doc_id", text_node().alias("node"))
    one = scratch.write(rows.select(text_node().alias("doc_id"), "text").dropDuplicates(["doc_id"]), "nodes")
    found = _components(spark, one, scratch).select(F.col("doc_id").alias("node"), "n_shingles", F.col("component_id").alias("component"))
    return scratch.write(nodes.join(found, "node").select("doc_id", "node", "n_shingles", "component"), "by-text")


def _components(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The columns of join_components for rows whose doc_ids are unique."""
    grams = hot_grams(rows)
    hot = spark.sparkContext.broadcast(grams)  # HOT_KEPT n-grams at most
    members, shared, bits = _shared_grams(spark, rows, hot, scratch)
    scratch.drop("prefixes")
    scratch.settle()
    # Equal sets are linked as they are, each with the smallest of them.
    equal = members.where("node <> doc_id").select("doc_id", "node")
    links = equal.select(F.col("doc_id").alias("x"), F.col("node").alias("y"))
    comps = equal.select(F.col("doc_id").alias("node"), F.col("node").alias("component"))
    rounds = (_hub_pairs("low"), _hub_pairs("high"), *map(_other_hub_pairs, range(OTHER_HUBS)), _all_pairs)
    for k, choose in enumerate(rounds):
        links, comps = _grow(rows, choose(shared, comps), bits, links, hot, scratch, f"round-{k}")
        scratch.settle()
    return members.join(comps.select("node", "component"), members["doc_id"] == comps["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _shared_grams(spark: SparkSession, rows: DataFrame, hot: Broadcast, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, node) of all rows, entries (gram, x, nx, px, entries, low, high) of prefix n-grams that several documents
    share (low and high are the entries of the bucket with the smallest and largest doc_id), and the bitmaps (doc_id, bits).

    In buckets of two or three entries those two meet all others, so such entries stay only where a pair is in bounds.
    """
    pre = scratch.write(prefixes(rows, hot), "prefixes")
    # Equal sets: one node each, the smallest doc_id.
    nodes = pre.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"))
    members = scratch.write(pre.select("doc_id", "n", "k1", "k2").join(nodes, ["k1", "k2", "n"], "left").select("doc_id", "n", F.coalesce("node", "doc_id").alias("node")), "members")
    placed = pre.select(F.col("doc_id").alias("x"), F.col("n").cast("int").alias("nx"), F.posexplode("prefix").alias("px", "gram"))
    # Frequent n-grams are known to be shared; all others are few, so one window holds a bucket.
    grams = hot.value[0]
    hot_table = spark.createDataFrame(pa.table({"gram": signed(grams)})) if len(grams) else spark.createDataFrame([], "gram long")
    is_hot = placed.join(F.broadcast(hot_table.withColumn("hot", F.lit(True))), "gram", "left")
    entry = F.struct(F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("px").alias("py"))
    # Ordered by document, so that only the entries are shuffled and not the structs made of them.
    w = Window.partitionBy("gram").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = lambda pick: F.struct(pick("x").over(w).alias("y"), pick("nx").over(w).alias("ny"), pick("px").over(w).alias("py"))
    columns = ("gram", "x", "nx", "px", "entries", "low", "high")
    rare = is_hot.where("hot is null").select("*", F.count("*").over(w).alias("entries"), end(F.first).alias("low"), end(F.last).alias("high")).where("entries > 1").select(*columns)
    often = scratch.write(is_hot.where("hot").select("gram", "x", "nx", "px"), "often")
    hubs = often.groupBy("gram").agg(F.count("*").alias("entries"), F.min(entry).alias("low"), F.max(entry).alias("high")).where("entries > 1")
    often = often.join(F.broadcast(hubs), "gram").select(*columns)  # HOT_KEPT rows at most
    useful = (F.col("entries") > 3) | _meets("low") | _meets("high")
    bits = scratch.write(pre.where("n > 0").select("doc_id", "bits"), "bits")
    return members, scratch.write(rare.unionByName(often).where(useful), "shared"), bits


def _meets(hub: str) -> Column:
    return (F.col("x") != F.col(f"{hub}.y")) & bounded(F.col("nx"), F.col(f"{hub}.ny"), F.col("px"), F.col(f"{hub}.py"))


def _hub_pairs(hub: str):
    """Entries with their bucket's hub, where they aren't connected yet."""

    def pairs(shared: DataFrame, comps: DataFrame) -> DataFrame:
        near = shared.where(_meets(hub)).select("x", F.col(f"{hub}.y").alias("y"), "nx", F.col(f"{hub}.ny").alias("ny")).distinct()
        return _with_component(_with_component(near, comps, "x"), comps, "y").where("x_component <> y_component")

    return pairs


def _other_hub_pairs(seed: int):
    """Entries of larger buckets that hold several components, with a further hub, which a hash of the document chooses."""

    def pairs(shared: DataFrame, comps: DataFrame) -> DataFrame:
        large = _with_component(shared.where("entries > 3").select("gram", "x", "nx", "px"), comps, "x")
        hub = F.min_by(F.struct(F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("px").alias("py"), F.col("x_component").alias("y_component")), F.xxhash64("x", F.lit(seed)))
        hubs = large.groupBy("gram").agg(F.min("x_component").alias("a"), F.max("x_component").alias("b"), hub.alias("hub")).where("a <> b").select("gram", "hub")
        near = large.join(hubs, "gram").where((F.col("x_component") != F.col("hub.y_component")) & bounded(F.col("nx"), F.col("hub.ny"), F.col("px"), F.col("hub.py")))
        return near.select("x", F.col("hub.y").alias("y"), "nx", F.col("hub.ny").alias("ny")).distinct()

    return pairs


def _all_pairs(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """All pairs in bounds of the larger buckets' entries that aren't connected yet.

    Of a pair, y is the smaller set. Its place in the bucket bounds the size of x, so it goes to the classes of those sizes.
    """
    large = _with_component(shared.where("entries > 3").select("gram", "x", "nx", "px"), comps, "x")
    mixed = large.groupBy("gram").agg(F.min("x_component").alias("a"), F.max("x_component").alias("b")).where("a <> b").select("gram")
    own = large.join(mixed, "gram", "left_semi").withColumn("size", _size_class(F.col("nx")))
    most = F.floor((DEN * F.col("nx").cast("long") - (NUM + DEN) * F.col("px")) / NUM)
    smaller = own.where(most >= F.col("nx")).select("gram", F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("px").alias("py"), F.col("x_component").alias("y_component"), F.explode(F.sequence("size", _size_class(most))).alias("size"))
    order = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") != F.col("y")))
    return own.join(smaller, ["gram", "size"]).where(order & (F.col("x_component") != F.col("y_component")) & bounded(F.col("nx"), F.col("ny"), F.col("px"), F.col("py")))


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * SIZE_CLASSES).cast("int")


def _with_component(rows: DataFrame, comps: DataFrame, node: str) -> DataFrame:
    of = comps.select(F.col("node").alias(node), F.col("component").alias(f"{node}_component"))
    return rows.join(of, node, "left").withColumn(f"{node}_component", F.coalesce(f"{node}_component", node))


def _grow(rows: DataFrame, pairs: DataFrame, bits: DataFrame, links: DataFrame, hot: Broadcast, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """All links so far and their components, after the pairs at the threshold are added."""
    first = F.col("x") < F.col("y")
    one = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.when(first, F.col("nx")).otherwise(F.col("ny")).cast("long").alias("nx"), F.when(first, F.col("ny")).otherwise(F.col("nx")).cast("long").alias("ny"))
    one = scratch.write(near_bitmaps(one.distinct(), bits), f"{name}-pairs")
    new = scratch.write(overlaps(rows, one, hot, scratch, name), f"{name}-links")
    scratch.drop(f"{name}-pairs", f"{name}-parts", f"{name}-ids")
    links = links.unionByName(new)
    return links, components(scratch, links, f"{name}-components")
