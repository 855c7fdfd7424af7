"""The queries of the training-data operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import language, line_rules, matroska, ngram_join, packing, piece_bpe, site_style, spelling, substring_dedup, token_alignment, token_files, toxicity, warc
from lodestone.llm.common import load

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(spark, load(spark, sf_dir, "pages"))


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, load(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_zstd_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_roundtrip(spark, load(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(load(spark, sf_dir, "documents")).drop("text_key")


def op5_nb_char_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encoding_digest(spark, load(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op7_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(spark, load(spark, sf_dir, "documents"))


def op8_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(spark, load(spark, sf_dir, "documents"))


def op9_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_query(spark, load(spark, sf_dir, "documents"))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digest(matroska.store_texts(spark, load(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spark, load(spark, sf_dir, "documents"))


def op12_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_roundtrip(spark, load(spark, sf_dir, "pages"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.token_alignment(spark, load(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_site_style_tree, op2_nnls_packing, op3_zstd_token_files, op4_line_frequency, op5_nb_char_toxicity, op6_piece_bpe, op7_fm_index_dedup, op8_vertical_jaccard, op9_bitmask_language, op10_matroska, op11_spelling_variants, op12_warc_writer, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_frequency": line_rules.LINE_RULES_SQL, "op11_spelling_variants": spelling.SPELLING_SQL, "op12_warc_writer": warc.WARC_SQL}
