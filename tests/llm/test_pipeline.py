"""The pipeline's stages, each against brute force on its own input."""

import hashlib
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from lodestone.llm import ngram_join, queries
from lodestone.llm.common import load
from test_text_operators import brute_components, brute_dedup, brute_rules
from tokenizers import Tokenizer


def test_queries_are_named_by_number():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


def test_stages(spark, sf, tmp_path):
    docs = load(spark, sf, "documents")
    columns = docs.columns
    inputs, outputs = [], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append({r.doc_id: r for r in docs.collect()})
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outputs.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    ids = [{r.doc_id for r in o} for o in outputs]
    text = [{d: r.text for d, r in i.items()} for i in inputs]
    # Quality: what brute force keeps, unchanged.
    assert ids[0] == {r[0] for r in brute_rules([(d, r.source, r.text) for d, r in inputs[0].items()], 20, 0.01, 0.3) if r[-1]}
    assert all(r.text == text[0][r.doc_id] for r in outputs[0])
    # Language: prose of the learned languages stays.
    assert ids[1] <= ids[0] and len(ids[1]) >= 0.99 * len(ids[0])
    # Near duplicates: the smallest id of each component.
    assert ids[2] == {c for _, _, c in brute_components(list(text[2].items()))}
    # Passages: the same words as brute force leaves.
    want = {d: (gone, sha) for d, _, gone, sha in brute_dedup(list(text[3].items()))}
    assert ids[3] == ids[2]
    for r in outputs[3]:
        gone, sha = want[r.doc_id]
        assert r.text == text[3][r.doc_id] if not gone else hashlib.sha256(r.text.encode()).hexdigest() == sha
        assert r.n_chars == len(r.text)
    # Packing: every id of every document, once.
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in outputs[4]:
        pieces[r.doc_id].append(r)
    assert set(pieces) == ids[3]
    for d, rows in pieces.items():
        x, at = t.encode(text[4][d] or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(x[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(x)


def test_clean_documents_stay(spark, sf):
    """Distinct prose of a learned language survives every filter, with its words."""
    base = load(spark, sf, "documents").where("lang = 'en' and n_chars between 1500 and 4000").limit(1).first()
    words = base.text.split()
    own = [(10_000_000 + k, " ".join(np.random.RandomState(k).permutation(words)[:150].tolist()), "en", "fresh", 0) for k in range(3)]
    docs = load(spark, sf, "documents")
    out = docs.unionByName(spark.createDataFrame(own, docs.schema))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, sf)
    kept = {r.doc_id: r.text for r in out.where("doc_id >= 10000000").collect()}
    assert kept == {d: t for d, t, *_ in own}


def test_stages_on_odd_rows(spark, sf, odd, none):
    """Nulls anywhere, empty and long texts, repeated rows and clashing columns, each stage by itself; and empty tables."""
    rows = odd.collect()
    out = [[(r.doc_id, r.text) for r in stage(spark, odd, sf).collect()] if k < 4 else stage(spark, odd, sf).collect() for k, (_, stage) in enumerate(corpus_pipeline.STAGES)]
    assert {d for d, _ in out[0]} == {5, 6, 7}
    assert {d for d, _ in out[1]} <= {r.doc_id for r in rows if any(map(str.isalpha, r.text or ""))}
    assert len(out[2]) == 8 and set(out[2]) == {(r.doc_id, r.text) for r in rows if r.doc_id not in (6, 7, 11)}
    want = {d: (gone, sha) for d, _, gone, sha in brute_dedup([(r.doc_id, r.text) for r in rows])}
    for d, t in out[3]:
        assert not want[d][0] or hashlib.sha256((t or "").encode()).hexdigest() == want[d][1]
    assert len(out[3]) == len(rows) and {r.doc_id for r in out[4]} == {r.doc_id for r in rows}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_repeated_and_null_ids(spark, sf):
    """Texts with one id, or none, are documents of their own; rejected rows with a null id go."""
    text = lambda k: " ".join(f"{chr(97 + k)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(80))
    rows = [(1, text(0)), (1, text(1)), (2, text(1) + " end"), (2, text(1) + " end"), (3, text(2)), (None, text(3)), (None, text(4)), (None, text(2) + " end"), (5, text(5))]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    order = lambda found: sorted(found, key=str)
    got = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert order((r.doc_id, r.text) for r in got) == order([(1, text(0)), (1, text(1)), (3, text(2)), (None, text(3)), (None, text(4)), (5, text(5))])
    joined = ngram_join.join_components(spark, docs).collect()
    assert order((r.doc_id, r.component_id) for r in joined) == order([(1, 1), (1, 1), (2, 1), (2, 1), (3, 3), (None, None), (None, None), (None, 3), (5, 5)])
    short = spark.createDataFrame([(None, "too short", "en", "a", 9), (None, text(6), "en", "a", 9)], docs.schema)
    assert [r.text for r in corpus_pipeline.quality_rules(spark, short, sf).collect()] == [text(6)]
