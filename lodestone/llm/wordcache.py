"""Token ids of whole texts by a per-worker cache of white-space words.

The word tokenizer lower-cases, drops white space and never merges across it, so a text's ids are the ids of its
white-space words one after another. Only words that a Python worker hasn't met are given to the tokenizers library:
plain ones run by run to its model, all others whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

from lodestone.llm.textkit import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words of one generation of a worker's cache; there are two, and results don't depend on it.
CACHE_WORDS, CACHE_RUNS = 150_000, 120_000
#: Longer words are encoded each time they occur.
CACHE_WORD_BYTES = 64
#: Words that are one run of letters, with or without one run of marks after it. Normalisation only lower-cases them, and
#: these runs are what the tokenizer's splitter would give its model.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#$%&*]+)?").fullmatch
#: Byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on, in order.
KEPT_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: b for b in KEPT_BYTES} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in KEPT_BYTES)}


class _Words(dict):
    """Ids of words, learned when they are first asked for. A full generation becomes the old one, from which words that
    are asked for again move up."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.old = learn, {}

    def turn(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: bytes) -> bytes:
        got = self.old.pop(word, None)
        if got is None:
            got = self.learn(word)
        if len(word) <= CACHE_WORD_BYTES:
            self[word] = got
        return got


class WordIds:
    """Little-endian unsigned 16-bit ids of texts, without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if sys.byteorder != "little":
            raise RuntimeError("ids are kept in the machine's byte order, which must be little-endian")

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.model = self.tokenizer.model
        self.cache = _Words(self._word)
        self.runs: dict[str, bytes] = {}

    def _run(self, run: str) -> bytes:
        """Ids of one run of letters or marks, by the library's model."""
        got = self.runs.get(run)
        if got is None:
            level = run.encode().decode("latin-1").translate(BYTE_LEVEL)
            got = self.runs[run] = array("H", [t.id for t in self.model.tokenize(level)]).tobytes()
        return got

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if m := PLAIN(text):
            return self._run(m[1].lower()) + (self._run(m[2]) if m[2] else b"")
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn; nulls are empty."""
        get = self.cache.__getitem__
        for text in texts:
            self.cache.turn()
            if len(self.runs) > CACHE_RUNS:
                self.runs.clear()
            yield b"".join(map(get, (text or "").encode().split()))

    def ids(self, text: str | None) -> bytes:
        return next(self.texts([text]))


_made: dict[str, WordIds] = {}


def _forget() -> None:
    _made.clear()


held["words"] = _forget


def encoder(path: str) -> WordIds:
    """The worker's own encoder for this vocabulary file, kept between tasks."""
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]
