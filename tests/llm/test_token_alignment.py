"""Alignment by whole texts, token by token, with both libraries."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from lodestone.llm import token_alignment
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LEVEL = dict(zip([*range(33, 127), *range(161, 173), *range(174, 256)], [*range(33, 127), *range(161, 173), *range(174, 256)], strict=True))
for byte in range(256):
    LEVEL.setdefault(byte, 256 + len([b for b in range(byte) if LEVEL[b] >= 256]))
BYTE = {chr(v): k for k, v in LEVEL.items()}


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    docs, linked = [], {}
    for _, text in rows:
        want = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(BYTE[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        groups = []
        if text and b"".join(raw_a) == want == b"".join(raw_b):
            i = j = end_a = end_b = 0
            while i < len(ids_a):
                start_i, start_j = i, j
                end_a, i = end_a + len(raw_a[i]), i + 1
                end_b, j = end_b + len(raw_b[j]), j + 1
                while end_a != end_b:
                    if end_a < end_b:
                        end_a, i = end_a + len(raw_a[i]), i + 1
                    else:
                        end_b, j = end_b + len(raw_b[j]), j + 1
                groups.append((ids_a[start_i:i], ids_b[start_j:j]))
        pairs = [(x, y) for g, h in groups for x in g for y in h]
        for p in set(pairs):
            linked[p] = linked.get(p, 0) + 1
        docs.append((groups, pairs))
    best = {}
    for (x, _), n in linked.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (doc_id, _), (groups, pairs) in zip(rows, docs, strict=True):
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((doc_id, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(pairs), sum(linked[p] == best[p[0]] for p in pairs), sum(linked[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def got(spark, docs, **more):
    return sorted(map(tuple, token_alignment.token_alignment(spark, docs, A, B, **more).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def random_text(draw):
    signs = ["a", "the", "Ing", "é", "ß", "漢字", "😀", " ", "  ", "\n", "\t", " ", "　", "\x1c", "'s", "'", "1", "234", ".", "!?", "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁" if draw.random() < 0.05 else "_", "\x00", "ﬁ", "é", "\r\n", "    ", "Straße", " ", "\u0085", "İ"]
    return "".join(draw.choice(signs) for _ in range(draw.randrange(60)))


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_random_texts(spark, few, monkeypatch):
    draw = random.Random(5 + few)
    rows = [(k, random_text(draw)) for k in range(700)] + [(1, None), (2, ""), (None, "a b"), (3, " "), (4, "  "), (5, "x "), (6, "x  "), (7, " x"), (8, "\n"), (9, "▁"), (10, "a b"), (10, "a b")]
    assert got(spark, spark.createDataFrame(rows, "doc_id long, text string"), broadcast_pairs=few) == brute(rows)


def test_trimmed_cache(monkeypatch):
    units = token_alignment.Units(A, B)
    texts = [random_text(random.Random(k)) + " word" * (k % 50) for k in range(300)]
    cut = [token_alignment.CUT.split(" " + t) for t in texts]
    plain = lambda at: [(units.text[i], units.n[i].tolist(), units.flat[units.first[i] : units.first[i + 1]].tolist()) for i in at]
    before = [plain(units.of(u)) for u in cut]
    monkeypatch.setattr(token_alignment, "CACHE_UNITS", 40)
    for u, want in zip(cut[::-1], before[::-1], strict=True):
        units.trim()
        assert len(units.text) == len(units.index) <= 20 or len(units.text) <= 40
        assert plain(units.of(u)) == want


def test_forgetful_cache(spark):
    rows = [(k, random_text(random.Random(k)) + " word" * (k % 50)) for k in range(300)]
    units = token_alignment.Units(A, B)
    before = [[units.text[i] for i in units.of(token_alignment.CUT.split(" " + t))] for _, t in rows]
    units.clear()
    assert units.n.shape == (0, 4)
    assert [[units.text[i] for i in units.of(token_alignment.CUT.split(" " + t))] for _, t in reversed(rows)][::-1] == before


def test_odd_rows(spark, odd, none):
    assert got(spark, odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert got(spark, none) == []


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(spark, docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_pair_table(spark):
    from lodestone.llm.common import Scratch
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, "c c")], "doc_id long, text string")
    size = sentencepiece.SentencePieceProcessor(model_file=B).get_piece_size()
    aligned = token_alignment.align_documents(spark, docs, A, B).withColumn("row", F.monotonically_increasing_id())
    assert sorted(r.n for r in token_alignment.pair_counts(aligned, size, Scratch(spark, "test")).collect()) == [1, 2, 2]
