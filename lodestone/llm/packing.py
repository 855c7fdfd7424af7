"""Packing of token sequences: repeat counts of length combinations by non-negative least squares.

Documents are cut into pieces of at most `window` tokens. A global histogram of piece sizes (in steps of `grain`
tokens) is a fixed number of integers whatever the input. All combinations of one to `depth` sizes that fill the window
are enumerated; non-negative least squares finds how often to repeat each so that the histogram is matched, and the counts
are rounded once, over the whole table, by largest remainders within the histogram.

Then every piece gets its number among the pieces of its size: its place in its task, which was written with it, and the
sum of what the tasks before have (a row for each task and size). The numbers of a size are dealt to the combinations in a few
intervals, so a piece knows its sequence wherever it lies, at any number of partitions. Sequences and the pieces that are left
go to blocks of bounded tokens, one shuffle of the pieces' ids; a block packs what is left greedily, best fit decreasing,
and cuts pieces freely to fill gaps. Whole windows of long documents are sequences of their own and aren't shuffled.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, ship, with_text
from lodestone.llm.textkit import blocks, lean
from lodestone.llm.wordcache import encoder

WINDOW, GRAIN, DEPTH = 2048, 16, 3
#: Tokens of the pieces that one task packs: bounds its memory.
BLOCK_TOKENS = 3_000_000
#: Rows of (task, size) up to which pieces' first numbers are broadcast; beyond, Spark joins by shuffling pieces.
BROADCAST_TASKS = 2_000_000


def combinations(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All non-increasing tuples of 1..depth sizes (in grains) whose sum is `bins`."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            slots = depth - len(head)
            for size in range(min(left, head[-1] if head else bins), 0, -1):
                if size * slots < left:
                    break
                extend((*head, size), left - size)

    extend((), bins)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """argmin |a x - b| over x >= 0 by an active set of columns (Lawson and Hanson)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0))) * a.shape[0]
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        j = int(np.argmax(gradient)) if n else 0
        if not n or gradient[j] <= tolerance:
            break
        active[j] = True
        while True:
            cols = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if z.min(initial=1.0) > 0:
                x[:] = 0
                x[cols] = z
                break
            low = z <= 0
            ratio = x[cols][low] / np.maximum(x[cols][low] - z[low], 1e-300)
            x[cols] += ratio.min() * (z - x[cols])
            x[cols[low][ratio <= ratio.min()]] = 0
            active[cols[x[cols] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def solve(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], float]]:
    """Combinations (sizes in grains) with repeat counts above 0; histogram[k]: pieces of k + 1 grains."""
    bins = len(histogram)
    combos = combinations(bins, depth)
    a = np.zeros((bins, len(combos)))
    for j, c in enumerate(combos):
        for size in c:
            a[size - 1, j] += 1
    total = histogram.sum()
    if not total:
        return []
    x = nnls(a, histogram / total)
    return [(combos[j], float(x[j] * total)) for j in np.flatnonzero(x > 1e-9)]


def rounded(mix: list[tuple[tuple[int, ...], float]], histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts within the histogram: rounded down, then the largest remainders up while their pieces last."""
    left = histogram.astype(np.int64).copy()

    def take(combo: tuple[int, ...], times: int) -> int:
        need = np.bincount(np.array(combo) - 1, minlength=len(left))
        times = min(times, *(int(left[s - 1] // need[s - 1]) for s in combo))
        left[:] -= need * times
        return times

    # What division has made a hair less than a whole number is that number.
    counts = [take(combo, int(count + 1e-6)) for combo, count in mix]
    for j in sorted(range(len(mix)), key=lambda j: (int(mix[j][1] + 1e-6) - mix[j][1], mix[j][0])):
        counts[j] += take(mix[j][0], 1)
    return [(combo, n) for (combo, _), n in zip(mix, counts, strict=True) if n]


def slots(repeats: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(size, first, end, lane): pieces of a size with numbers from `first` to `end` go to sequences from `lane` on, one each."""
    used: dict[int, int] = defaultdict(int)
    out, lane = [], 0
    for combo, times in repeats:
        for size in combo:
            out.append((size, used[size], used[size] + times, lane))
            used[size] += times
        lane += times
    return out


def pack_rows(rows: list[list[tuple[int, int, int]]], left: list[tuple[int, int, int]], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document index, start, length): those given, and what is left packed greedily; then gaps are filled."""
    open_ = [(window - sum(p[2] for p in row), row) for row in rows]
    # Residual pieces: largest first, into new windows; then the smallest are cut up to fill every gap.
    left = sorted(left, key=lambda p: (p[2], p[0], p[1]))
    low, high = 0, len(left) - 1
    while low <= high:
        row, room = [left[high]], window - left[high][2]
        high -= 1
        while low <= high and room:
            if left[high][2] <= room:
                p = left[high]
                high -= 1
            else:
                p = left[low]
                low += 1
                if p[2] > room:
                    row.append((p[0], p[1], room))
                    low -= 1
                    left[low] = (p[0], p[1] + room, p[2] - room)
                    room = 0
                    break
            row.append(p)
            room -= p[2]
        open_.append((room, row))
    return _fill(open_, window)


def _fill(rows: list[tuple[int, list[tuple[int, int, int]]]], window: int) -> list[list[tuple[int, int, int]]]:
    """Empty the sequences with most room into the gaps of the others, cutting pieces where a gap ends."""
    rows = sorted(rows, key=lambda r: (-r[0], r[1][0]))
    gaps = sum(r[0] for r in rows)
    spare = gaps // window  # so many sequences can go
    donors, keep = rows[:spare], rows[spare:]
    pieces = [p for _, row in donors for p in row][::-1]
    out = []
    for room, row in keep:
        row = list(row)
        while room and pieces:
            d, s, n = pieces.pop()
            row.append((d, s, min(n, room)))
            if n > room:
                pieces.append((d, s + room, n - room))
            room -= min(n, room)
        out.append(row)
    row, room = [], window
    while pieces:
        d, s, n = pieces.pop()
        row.append((d, s, min(n, room)))
        if n > room:
            pieces.append((d, s + room, n - room))
        room -= min(n, room)
        if not room:
            out.append(row)
            row, room = [], window
    return out + [row] * bool(row)


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, size int, task long, nth long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_pieces(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, grain: int = GRAIN, keep: str = "words") -> DataFrame:
    """PIECES of all documents: whole windows (size 0) and one rest each, of `size` grains, the `nth` of its task with that size. ids are
    unsigned 16-bit, with the end id."""
    ship(spark)
    end = np.array([end_id], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, task, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), defaultdict(int)
        for b in (x for batch in batches for x in blocks(batch, "text")):
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, raw in zip(b.column(0).to_pylist(), words.texts(b.column(1).to_pylist()), strict=True):
                raw += end
                n = len(raw) // 2
                for at in range(0, n, window):
                    length = min(window, n - at)
                    size = -(-length // grain) if length < window else 0
                    for c, v in zip(cols, (doc_id, at, length, n, raw[2 * at : 2 * (at + length)], size, task, seen[size]), strict=True):
                        c.append(v)
                    seen[size] += 1
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return with_text(docs).mapInArrow(lean(encode, keep), PIECES)


def numbered(rests: DataFrame) -> DataFrame:
    """Pieces with their `number` among those of their size, over all tasks."""
    counts = rests.groupBy("size", "task").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("size", "task", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("first"))
    few = counts.count() <= BROADCAST_TASKS
    return rests.join(F.broadcast(first) if few else first, ["size", "task"]).withColumn("number", F.col("first") + F.col("nth"))


def _packed(pieces: list[tuple[int, int, int]], doc_ids: list, raws: list[bytes], starts: list[int], totals: list[int], lane: int, cols: list[list]) -> None:
    """Add a sequence's pieces (row, start within the row's piece, length) to the columns of PACKED."""
    offset = 0
    for i, at, n in pieces:
        crc = zlib.crc32(np.frombuffer(raws[i], "<u2", n, 2 * at).astype("<u4").tobytes())
        for c, v in zip(cols, (doc_ids[i], starts[i] + at, n, crc, totals[i], lane, offset), strict=True):
            c.append(v)
        offset += n


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, grain: int = GRAIN, scratch: Scratch | None = None, keep: str = "words") -> DataFrame:
    """Pack all documents: one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null or empty texts are one piece with the
    end id; rows that repeat a doc_id, or have none (null), are packed each with the doc_id they have; further columns are ignored; an empty table
    gives no rows. Token ids are written once to the shared folder; pieces shorter than a window are shuffled once. Workers keep what they know of words
    from task to task, unless `keep` is empty: then they hold less between the steps of a longer job.
    """
    scratch = scratch or Scratch(spark, "packing")
    pieces = scratch.write(cut_pieces(spark, docs, tokenizer_path, end_id, window, grain, keep), "pieces")
    rests = pieces.where("size > 0")
    counted = rests.groupBy("size").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect()  # window / grain rows
    histogram = np.zeros(window // grain)
    for r in counted:
        histogram[r["size"] - 1] = r.n
    repeats = rounded(solve(histogram), histogram)
    n_blocks = max(1, -(-sum(r.tokens for r in counted) // BLOCK_TOKENS))
    # A few intervals for each size: some hundred rows at any input size.
    table = spark.createDataFrame(slots(repeats), "of int, low long, high long, lane long")
    inside = (F.col("size") == F.col("of")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))
    dealt = numbered(rests).join(F.broadcast(table), inside, "left").withColumn("at", F.col("lane") + F.col("number") - F.col("low"))
    block = F.pmod(F.coalesce("at", F.col("number") + F.col("size")), F.lit(n_blocks)).cast("int").alias("block")
    together = dealt.select("doc_id", "start", "length", "doc_tokens", "ids", "at", block).repartitionById(n_blocks, "block")
    names = [x.split()[0] for x in PACKED.split(", ")]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)  # BLOCK_TOKENS, but for chance
        doc_ids, starts, lengths, totals, raws, lanes = ([x for b in held for x in b.column(c).to_pylist()] for c in ("doc_id", "start", "length", "doc_tokens", "ids", "at"))
        rows, left = defaultdict(list), []
        for i, (n, at) in enumerate(zip(lengths, lanes, strict=True)):
            (left if at is None else rows[at]).append((i, 0, n))
        cols: list[list] = [[] for _ in names]
        for k, row in enumerate(pack_rows([rows[at] for at in sorted(rows)], left, window)):
            _packed(row, doc_ids, raws, starts, totals, TaskContext.get().partitionId() << 40 | k << 1, cols)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids, starts, totals, raws, task, nth = (b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids", "task", "nth"))
            cols: list[list] = [[] for _ in names]
            for i in range(b.num_rows):
                _packed([(i, 0, window)], doc_ids, raws, starts, totals, task[i] << 40 | nth[i] << 1 | 1, cols)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return together.mapInArrow(lean(fill), PACKED).unionByName(pieces.where("size = 0").mapInArrow(lean(whole), PACKED))
