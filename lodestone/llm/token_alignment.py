"""Alignment of two tokenizers over a corpus: groups of tokens between common cuts, and how many documents link each id pair.

Bytes of a text are cut by both tokenizers; offsets where tokens of both end are common cuts, and tokens between two of
them are a group. Every A token of a group is linked with every B token of it.

Texts are first cut into units: before each space that follows something other than white space. No token of either kind
spans such a place (tokens of A come from its splitter, which ends there; pieces of B have spaces at their start only), so
units are encoded and aligned on their own, each distinct one once for each worker's cache, and a document is the sequence of its units. All units a
block of documents brings anew are aligned together: cumulative sums of token bytes give the ends, intersect1d the
common cuts, searchsorted the group of each token, and repeats expand groups to links.

Pairs are counted in two shuffles: by pair and a salt, then by pair, since some pairs are in nearly every document. Counts
are joined to the documents' distinct pairs: broadcast where they were counted and are at most `BROADCAST_PAIRS`, else by a
shuffle join, which Spark splits at frequent pairs. Each document's sums are taken where its pairs are, before the last shuffle.

Costs: texts are read and encoded once; documents' distinct pairs are written once (a code and how often, for each).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, ship, with_text
from lodestone.llm.textkit import blocks, held, lean

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct units, and bytes of their digest texts, that a worker keeps from block to block; results don't depend on it.
CACHE_UNITS, CACHE_BYTES = 150_000, 16 << 20
#: Pairs of ids up to which counts are broadcast: some 100 MB as a hash table.
BROADCAST_PAIRS = 1_500_000
#: Parts into which the rows of a pair are dealt when they are counted.
SALTS = 64
#: Before a space that follows something else: no token of A or B spans this place.
CUT = re.compile(r"(?<=\S)(?= )")
#: Byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on, in order.
KEPT_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
LEVEL_BYTE = {chr(b): b for b in KEPT_BYTES} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in KEPT_BYTES)}
DOCUMENTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each A and of each B token, and the number of groups, from the tokens' byte ends (ascending)."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # no token is empty
    return np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), len(cuts)


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many: the group of each member, and its place within the group."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def links(group_a: np.ndarray, group_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the A and B tokens of all links; tokens are in order, so those of a group stand together."""
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    owner, place = expand(n_a * n_b)
    return (np.cumsum(n_a) - n_a)[owner] + place // np.maximum(n_b[owner], 1), (np.cumsum(n_b) - n_b)[owner] + place % np.maximum(n_b[owner], 1)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


class Units:
    """Aligned units of one worker: for each distinct unit its token counts, groups, link codes and digest text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size_a = self.a.get_vocab_size()
        self.size_b = self.b.get_piece_size()
        self.bytes_a = [bytes(LEVEL_BYTE[c] for c in t) if (t := self.a.id_to_token(i)) and all(c in LEVEL_BYTE for c in t) else (t or "").encode() for i in range(size_a)]
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size_b)]
        if any(b" " in x.lstrip(b" ") for x in self.bytes_b):
            raise ValueError("pieces with inner spaces need another way of cutting texts")
        self.length_a, self.length_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.space_b = self.b.piece_to_id("▁")
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[bytes] = []
        self.n = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.flat, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _a_ids(self, units: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A of all units, and how many each has. Units that end with no white space are encoded in one text, where
        they are cut as on their own."""
        if not any(u[-1].isspace() for u in units):
            flat = np.array(self.a.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, np.int64)
            ends, want = np.cumsum(self.length_a[flat]), np.cumsum(sizes)
            at = np.searchsorted(ends, want)
            if len(ends) and at[-1] < len(ends) and (ends[at] == want).all():
                return flat, np.diff(at + 1, prepend=0)
        return _flat([e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)])

    def _b_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of B of all units, and how many each has: of what follows the first space, as the library puts its own before
        that; but it gives nothing for an empty text."""
        return _flat([x or [self.space_b] for x in self.b.encode([u[1:] for u in units], num_threads=1)])

    def learn(self, units: list[str]) -> None:
        """Align units that aren't known yet. Those whose bytes either tokenizer doesn't give back have -1 A tokens."""
        raw = [u.encode() for u in units]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        sides = [(*self._a_ids(units, sizes), self.bytes_a, self.length_a), (*self._b_ids(units), self.bytes_b, self.length_b)]
        sound = np.logical_and(*(self._given_back(*side, raw, sizes) for side in sides))
        (flat_a, count_a), (flat_b, count_b) = ((flat[np.repeat(sound, count)], np.where(sound, count, 0)) for flat, count, *_ in sides)
        # Units stand one after another, so that all are aligned at once; the end of each is a common cut.
        group_a, group_b, groups = align(np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b]))
        link_a, link_b = links(group_a, group_b, groups)
        unit_a, unit_b = np.repeat(np.arange(len(units)), count_a), np.repeat(np.arange(len(units)), count_b)
        per_link = np.bincount(unit_a[link_a], minlength=len(units))
        per_group = np.bincount(unit_a[np.flatnonzero(np.diff(group_a, prepend=-1))], minlength=len(units))
        n = np.stack([np.where(sound, count_a, -1), count_b, per_group, per_link], 1)
        self.n = np.concatenate([self.n, n])
        self.flat = np.concatenate([self.flat, flat_a[link_a] * self.size_b + flat_b[link_b]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(per_link)])
        self.text += self._digest_texts(len(units), flat_a, flat_b, group_a, group_b, unit_a, unit_b)

    def _given_back(self, flat: np.ndarray, count: np.ndarray, parts: list[bytes], length: np.ndarray, raw: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each unit give its bytes back."""
        ends, ids = np.cumsum(count), flat.tolist()
        if (np.concatenate([[0], np.cumsum(length[flat])])[ends] == np.cumsum(sizes)).all() and b"".join(map(parts.__getitem__, ids)) == b"".join(raw):
            return np.ones(len(raw), bool)
        return np.array([b"".join(map(parts.__getitem__, ids[z - k : z])) == r for z, k, r in zip(ends.tolist(), count.tolist(), raw, strict=True)])

    def _digest_texts(self, n_units: int, flat_a, flat_b, group_a, group_b, unit_a, unit_b) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each unit. Each token is written with the sign that follows it."""
        side = np.concatenate([np.zeros(len(flat_a), np.int64), np.ones(len(flat_b), np.int64)])
        group, unit, ids = np.concatenate([group_a, group_b]), np.concatenate([unit_a, unit_b]), np.concatenate([flat_a, flat_b])
        o = np.argsort(group * 2 + side, kind="stable")
        side, group, unit, ids = side[o], group[o], unit[o], ids[o]
        key = group * 2 + side
        last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
        sign = np.where(last, np.where(side == 0, "|", ";"), ",")
        parts = [f"{i}{s}" for i, s in zip(ids.tolist(), sign.tolist(), strict=True)]
        ends = np.searchsorted(unit, np.arange(n_units), side="right").tolist()
        return ["".join(parts[a:z]).encode() for a, z in zip([0, *ends[:-1]], ends, strict=True)]

    def of(self, units: list[str]) -> np.ndarray:
        """Indices of units, learned if they are new."""
        new = list(dict.fromkeys(u for u in units if u not in self.index))
        if new:
            start = len(self.text)
            new.sort(key=lambda u: u[-1].isspace())
            self.index |= {u: start + k for k, u in enumerate(new)}
            odd = sum(u[-1].isspace() for u in new)
            for part in (new[: len(new) - odd], new[len(new) - odd :]):
                if part:
                    self.learn(part)
        at = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        self.uses = np.bincount(at, minlength=len(self.text)) + np.append(self.uses, np.zeros(len(self.text) - len(self.uses), np.int64))
        return at

    def trim(self) -> None:
        """Between blocks: when units have become many, keep the half that is used most, and no long ones."""
        size = np.fromiter(map(len, self.text), np.int64, len(self.text))
        if len(self.text) <= CACHE_UNITS and size.sum() <= CACHE_BYTES:
            return
        kept = np.flatnonzero(size <= 4 * CACHE_BYTES // CACHE_UNITS)
        kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: CACHE_UNITS // 2]])
        units, text = list(self.index), self.text
        self.index = {units[i]: k for k, i in enumerate(kept.tolist())}
        self.text = [text[i] for i in kept.tolist()]
        owner, place = expand(self.n[kept, 3])
        self.flat = self.flat[self.first[kept][owner] + place]
        self.n, self.uses = self.n[kept], self.uses[kept] // 2
        self.first = np.concatenate([[0], np.cumsum(self.n[:, 3])])


_made: dict[tuple[str, str], Units] = {}
held["units"] = lambda: [u.clear() for u in _made.values()]


def aligner(path_a: str, path_b: str) -> Units:
    if (path_a, path_b) not in _made:
        _made[path_a, path_b] = Units(path_a, path_b)
    return _made[path_a, path_b]


def align_documents(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """DOCUMENTS for every row of `docs` (doc_id, text): its sums, the digest of its groups, and its distinct linked pairs (code: A id times B's
    vocabulary size, plus B id), ascending, with how often each is linked."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(path_a, path_b)
        for b in (x for batch in batches for x in blocks(batch, "text")):
            known.trim()
            cut = [CUT.split(f" {t}") if t else [] for t in b.column(1).to_pylist()]
            count = np.array([len(x) for x in cut], np.int64)
            at = known.of([u for units in cut for u in units])
            row = np.repeat(np.arange(len(cut)), count)
            sound = np.ones(len(cut), bool)
            sound[row[known.n[at, 0] < 0]] = False
            n = np.where(sound[row, None], known.n[at], 0)
            total = np.zeros((len(at) + 1, 4), np.int64)
            np.cumsum(n, axis=0, out=total[1:])
            ends = np.cumsum(count)
            sums = total[ends] - total[ends - count]
            text, places = known.text, at.tolist()
            shas = [hashlib.sha256(b"".join(map(text.__getitem__, places[z - k : z]))[:-1]).hexdigest() if k and ok else "" for z, k, ok in zip(ends.tolist(), count.tolist(), sound.tolist(), strict=True)]
            owner, place = expand(n[:, 3])
            codes, times = np.unique(row[owner] << 31 | known.flat[known.first[at[owner]] + place], return_counts=True)
            offsets = pa.array(np.searchsorted(codes, np.arange(len(cut) + 1) << 31).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (codes & ((1 << 31) - 1), times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(sums[:, k]) for k in range(4)), pa.array(shas), *lists], [c.split()[0] for c in DOCUMENTS.split(", ")])

    return with_text(docs).mapInArrow(lean(run, "units"), DOCUMENTS)


def pair_counts(aligned: DataFrame, size_b: int, scratch: Scratch) -> DataFrame:
    """(pair, a, b, n, best) of all linked id pairs: how many documents link them, and whether no other B id of that A id has more."""
    each = aligned.select(F.explode("pairs").alias("pair"), F.pmod(F.col("row"), F.lit(SALTS)).alias("salt"))
    counts = scratch.write(each.groupBy("pair", "salt").agg(F.count("*").alias("n")).groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("pair") / size_b)), "counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    # One row for each id of A's vocabulary at most.
    rated = counts.join(F.broadcast(most), "a").select("pair", "a", F.pmod("pair", F.lit(size_b)).alias("b"), "n", (F.col("n") == F.col("most")).alias("best"))
    return scratch.write(rated, "pairs")


def token_alignment(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of `docs` (doc_id, text).

    Null and empty texts, and texts whose bytes a tokenizer doesn't give back, have no tokens: zeros, and an empty
    groups_sha256. Every row is a document of its own, so repeated rows count each; a null doc_id is kept; long texts are
    taken whole; of pairs with equal counts all are best. Further columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark, "alignment")
    aligned = scratch.write(align_documents(spark, docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "documents")
    import sentencepiece

    rated = pair_counts(aligned, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size(), scratch).select("pair", "n", "best")
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").cast("long").alias("times"))
    few = rated.count() <= broadcast_pairs
    sums = each.join(F.broadcast(rated) if few else rated, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return aligned.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
