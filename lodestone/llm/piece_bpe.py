"""SentencePiece merge-type encoding by a prefix table, and decoding.

For merge-type (BPE) vocabularies every prefix of a text has exactly one last token. Let `last[i]` be the last token of
the encoding of the first i characters. A token t that ends at i and starts at j is that token if and only if it and
`last[j]` stay apart when merged together (they are compatible), or j = 0. So one pass over the matches of an
Aho-Corasick automaton of all pieces fills the table, and ids are read off backwards from the end.

Texts are cut at places that no piece spans: before a run of spaces, and around characters outside the vocabulary.
The ids of a unit (a run of spaces with the characters after it) are kept in a per-worker cache.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import ship, with_text
from lodestone.llm.textkit import blocks, held, lean

CACHE_UNITS = 300_000
SPACE = "▁"
#: Longest unit that is cached, in characters; longer ones are encoded each time.
CACHE_CHARS = 48


class PieceBPE:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.eos = lib.eos_id()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.id[piece], self.score[piece] = i, lib.get_score(i)
        self.unknown = lib.unk_id()
        self.piece = {i: p for p, i in self.id.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces with inner spaces need another way of cutting texts")
        #: A piece that its own characters don't merge into never appears.
        self.whole = {i for p, i in self.id.items() if self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if i in self.whole:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        joined = {c for p in self.id if len(p) > 1 for c in p}
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        # Units: spaces with what follows them; characters that are in no longer piece stand alone.
        plain = "".join(re.escape(c) for c in sorted(joined - {SPACE}))
        self.unit = re.compile(f"{SPACE}*[{plain}]+|{SPACE}+|[^{plain}{SPACE}]", re.DOTALL)

    def merged(self, text: str) -> list[str]:
        """Plain merging: the adjacent pair with the highest score first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        got = self.pairs.get(key)
        if got is None:
            a, b = self.piece[left], self.piece[right]
            got = self.pairs[key] = self.merged(a + b) == [a, b]
        return got

    def unit_ids(self, unit: str) -> tuple[int, ...]:
        """Prefix table over one unit."""
        n = len(unit)
        last = [-1] * (n + 1)
        back = [0] * (n + 1)
        pairs = self.pairs
        for end, (i, size) in self.automaton.iter(unit):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = pairs.get(before << 20 | i)
                if ok is None:
                    ok = self.compatible(before, i)
                if not ok:
                    continue
            last[end], back[end] = i, start
        out, at = [], n
        while at:
            i = last[at]
            if i < 0:  # characters without a piece of their own: bytes
                if n == 1:
                    return self._fallback(unit)
                runs = self._known_runs(unit)
                if len(runs) > 1:
                    return tuple(x for c in runs for x in self.unit_ids(c))
                # No chain of compatible pieces: merge as the vocabulary says.
                return tuple(x for p in self.merged(unit) for x in ((self.id[p],) if p in self.id else self._fallback(p)))
            out.append(i)
            at = back[at]
        return tuple(reversed(out))

    def _known_runs(self, unit: str) -> list[str]:
        runs: list[str] = []
        for c in unit:
            if runs and c in self.id and runs[-1][-1] in self.id:
                runs[-1] += c
            else:
                runs.append(c)
        return runs

    def _fallback(self, char: str) -> tuple[int, ...]:
        if self.bytes:
            return tuple(self.bytes[b] for b in char.encode())
        return (self.unknown,)

    def encode(self, text: str | None) -> list[int]:
        """Ids without control ids; null is empty."""
        if not text:
            return []
        cache = self.cache
        out: list[int] = []
        add = out.extend
        for unit in self.unit.findall(SPACE + text.replace(" ", SPACE)):
            got = cache.get(unit)
            if got is None:
                got = self.unit_ids(unit)
                if len(unit) <= CACHE_CHARS:
                    if len(cache) >= CACHE_UNITS:
                        cache.clear()
                    cache[unit] = got
            add(got)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, bytes as UTF-8 (replacement characters where invalid), the first space dropped.

        This is the library's own decoder, given the ids.
        """
        return self.library.decode(ids)


_made: dict[str, PieceBPE] = {}


def _forget() -> None:
    for made in _made.values():
        made.cache.clear()
        made.pairs.clear()


held["pieces"] = _forget


def coder(path: str) -> PieceBPE:
    if path not in _made:
        _made[path] = PieceBPE(path)
    return _made[path]


def encode_documents(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids array<int> (with the end id), decoded string, for every row; null or empty texts give the end id alone.

    Repeated rows are encoded each; other columns are ignored; an empty table gives no rows.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model_path)
        for b in (x for batch in batches for x in blocks(batch, "text")):
            ids = [c.encode(t) + [c.eos] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(c.library.decode(ids) if ids else [], pa.string())})

    return with_text(docs).mapInArrow(lean(run, "pieces"), "doc_id long, ids array<int>, decoded string")


def encoding_digest(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """The query's columns, made where the ids are: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model_path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in (x for batch in batches for x in blocks(batch, "text")):
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t) + [c.eos]
                n.append(len(ids))
                ids_sha.append(sha(" ".join(map(str, ids))))
                text_sha.append(sha(c.decode(ids)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    return with_text(docs).mapInArrow(lean(run, "pieces"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
