"""Token files, packing, piece BPE and media: exact round trips and the libraries' own results."""

import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from lodestone.llm import matroska, packing, piece_bpe, token_files, wordcache
from tokenizers import Tokenizer

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def ids(odd):
    t = Tokenizer.from_file(WORD)
    return sorted((r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in odd.collect())


def test_word_cache_is_the_library():
    t, c = Tokenizer.from_file(WORD), wordcache.encoder(WORD)
    texts = ["", None, "Don't STOP, it's <|endoftext|>x 12a b", "É́é ﬁ İ Σς", "a" * 500, "x\x1cy\x85z", "a,b. c!! d|"]
    assert [np.frombuffer(r, "<u2").tolist() for r in c.texts(texts)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_token_roundtrip(spark, odd, none, ids):
    got = sorted(tuple(r) for r in token_files.token_roundtrip(spark, odd, WORD).collect())
    at, want = 0, []
    for d, x in ids:
        want.append((d, at, len(x), crc(x)))
        at += len(x)
    assert got == want
    assert token_files.token_roundtrip(spark, none, WORD).count() == 0


def test_reader_reads_only_asked_frames():
    out = io.BytesIO()
    w = token_files.Writer(out, frame_ids=10)
    docs = {d: np.arange(d, d + 7, dtype="<u2").tobytes() for d in range(0, 40, 2)}
    for d, raw in docs.items():
        w.add(d, raw)
    w.close()
    raw = out.getvalue()
    r = token_files.Reader(io.BytesIO(raw), len(raw))
    read = []
    r.frame = lambda k, f=r.frame: (read.append(k), f(k))[1]
    assert list(r.read(r.find([6, 30]))) == [(6, docs[6]), (30, docs[30])]
    assert len(read) == 2 < len(r.frames)
    damaged = bytearray(raw)
    damaged[12] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        list(token_files.Reader(io.BytesIO(bytes(damaged)), len(raw)).read([0]))
    damaged = bytearray(raw)
    damaged[-40] ^= 255
    with pytest.raises(ValueError):
        token_files.Reader(io.BytesIO(bytes(damaged)), len(raw))


def test_nnls():
    r = np.random.RandomState(1)
    a, x = r.rand(12, 6), np.array([0, 2, 0, 1, 3, 0.5])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    assert packing.nnls(np.eye(2), np.array([-1.0, 2.0])).tolist() == [0, 2]
    assert set(packing.combinations(4, 3)) == {(4,), (3, 1), (2, 2), (2, 1, 1)}


def test_packing_covers_all_ids(spark, odd, none, ids):
    rows = packing.pack(spark, odd, WORD).collect()
    assert packing.pack(spark, none, WORD).count() == 0
    want = defaultdict(list)
    for d, x in ids:
        want[d].append(x)
    seen, lanes = defaultdict(list), defaultdict(list)
    for r in rows:
        seen[r.doc_id, r.doc_tokens].append(r)
        lanes[r.sequence_id].append(r)
        assert r.ids_crc32 in {crc(x[r.start : r.start + r.length]) for x in want[r.doc_id]}
    assert sum(r.length for r in rows) == sum(len(x) for _, x in ids)
    for lane in lanes.values():
        at = 0
        for r in sorted(lane, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW


def test_packing_leaves_little_room():
    r = np.random.RandomState(3)
    n = np.minimum(r.lognormal(6, 1, 4000).astype(int) + 1, 30000)
    hist = np.zeros(packing.WINDOW // packing.GRAIN)
    rest = n % packing.WINDOW
    np.add.at(hist, -(-rest[rest > 0] // packing.GRAIN) - 1, 1)
    repeats = packing.rounded(packing.solve(hist), hist)
    stock, rows, left = defaultdict(list), [[(i, at, packing.WINDOW)] for i, k in enumerate(n) for at in range(0, k // packing.WINDOW * packing.WINDOW, packing.WINDOW)], []
    for i, k in enumerate(rest.tolist()):
        stock[-(-k // packing.GRAIN)].append((i, int(n[i]) - k, k))
    lanes = defaultdict(list)
    for size, low, high, lane in packing.slots(repeats):
        for k, piece in enumerate(stock[size][low:high]):
            lanes[lane + k].append(piece)
    assert len(lanes) == sum(times for _, times in repeats)
    high = {size: max(h for s, _, h, _ in packing.slots(repeats) if s == size) for size, *_ in packing.slots(repeats)}
    rows += packing.pack_rows(list(lanes.values()), [p for size, x in stock.items() if size for p in x[high.get(size, 0) :]])
    assert n.sum() / (len(rows) * packing.WINDOW) > 0.995
    got = defaultdict(int)
    for row in rows:
        for i, _, k in row:
            got[i] += k
    assert [got[i] for i in range(len(n))] == n.tolist()


def test_piece_bpe_is_the_library(spark, odd, none):
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), piece_bpe.coder(PIECE)
    rnd = random.Random(7)
    alphabet = "abcdeéß .  \n\t▁😀<0x41>thion ingeŕ漢字"
    for _ in range(3000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) + " " * rnd.randint(0, 40)
        assert own.encode(t) == lib.encode(t)
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in odd.collect():
        x = lib.encode(r.text or "") + [lib.eos_id()]
        want.append((r.doc_id, len(x), h(" ".join(map(str, x))), h(lib.decode(x))))
    assert sorted(map(tuple, piece_bpe.encoding_digest(spark, odd, PIECE).collect())) == sorted(want)
    assert piece_bpe.encode_documents(spark, odd, PIECE).count() == 12
    assert piece_bpe.encoding_digest(spark, none, PIECE).count() == 0


def test_media(spark, odd, none):
    got = {r.doc_id: r for r in matroska.media_digest(matroska.store_texts(spark, odd)).collect()}
    for r in odd.collect():
        raw = (r.text or "").encode()
        pad = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert matroska.media_digest(matroska.store_texts(spark, none)).count() == 0
    table = matroska.packet_table(spark, matroska.store_texts(spark, odd)).where("key = 8")
    assert table.selectExpr("sum(size)").first()[0] == 60032


def test_lacing_and_damage(spark):
    frames = [b"a" * 300, b"b" * 2, b"c" * 700]
    for lacing in (matroska.XIPH_LACING, matroska.EBML_LACING):
        cluster = matroska.uint(matroska.TIMESTAMP, 5) + matroska.element(matroska.SIMPLE_BLOCK, matroska.block(1, -2, frames, lacing, 0x80))
        raw = matroska.element(matroska.EBML, b"") + matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, cluster))
        m = matroska.parse(raw)
        assert [raw[p[2] : p[2] + p[3]] for p in m.packets] == frames
        assert m.packets[0][1] == 3_000_000
    open_ended = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
    assert len(matroska.parse(open_ended).packets) == 3
    whole = matroska.mux(bytes(5000) + b"x" * 100)
    m = matroska.parse(whole)
    assert m.doc_type == "matroska" and m.tracks[1]["bits"] == 8 and len(m.cues) == len(m.clusters)
    assert all(whole[at : at + 4] == matroska.CLUSTER.to_bytes(4, "big") for _, _, at in m.cues)
    bad = spark.createDataFrame([(1, bytearray(whole[:900])), (2, None), (3, bytearray(b""))], "doc_id long, media binary")
    rows = matroska.packet_table(spark, bad).collect()
    assert [(r.key, r.packet) for r in rows] == [(1, -1)]


def test_rounding_keeps_to_the_histogram():
    r = np.random.RandomState(5)
    for size, share in ((40, 0.4), (400, 0.85), (40_000, 0.98)):
        hist = np.bincount(r.randint(0, 128, size), minlength=128).astype(float)
        mix = packing.solve(hist)
        repeats = packing.rounded(mix, hist)
        used = np.zeros(128)
        for combo, times in repeats:
            for s in combo:
                used[s - 1] += times
        assert (used <= hist).all() and sum(t for _, t in repeats) >= share * sum(c for _, c in mix)
    assert packing.rounded([], np.zeros(128)) == [] and packing.slots([]) == []


@pytest.mark.parametrize("partitions", [1, 8, 32])
def test_solved_rows_at_any_partitioning(spark, partitions):
    from lodestone.llm.common import Scratch

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(partitions)
    scratch = Scratch(spark, "test-packing")
    packed = packing.pack(spark, docs, WORD, scratch=scratch).collect()
    pieces = spark.read.parquet(scratch.path("pieces")).where("size > 0").collect()
    hist = np.bincount([p["size"] - 1 for p in pieces], minlength=128).astype(float)
    solved = [combo for combo, times in packing.rounded(packing.solve(hist), hist) for _ in range(times)]
    assert len(solved) > 0.85 * sum(c for _, c in packing.solve(hist))
    lanes = defaultdict(list)
    for r in packed:
        lanes[r.sequence_id].append(r)
    # Of every solved row the first pieces, as many as its combination has, are of the combination's sizes.
    found = defaultdict(int)
    for lane in lanes.values():
        first = sorted(lane, key=lambda r: r.offset)
        for k in (1, 2, 3):
            found[tuple(sorted((-(-r.length // packing.GRAIN) for r in first[:k]), reverse=True))] += len(first) >= k
    want = defaultdict(int)
    for combo in solved:
        want[combo] += 1
    assert sum(min(n, found[c]) for c, n in want.items()) >= 0.9 * len(solved)
    assert sum(r.length for r in packed) / (len(lanes) * packing.WINDOW) > 0.99
