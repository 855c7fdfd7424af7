"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, and its decisions take effect: rejected documents go, repeated passages are cut
out of texts, and the last stage returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language, line_rules, ngram_join, packing, substring_dedup
from lodestone.llm.common import Scratch, load, only, ship, with_text, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents of which fewer n-grams than this are known in any language are rejected.
MIN_COVERAGE = 0.5
TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are depleted of lines their host repeats, go; such lines go from the others.

    Null, empty and short texts fail the base rules; a null source is a host of its own; very long texts are taken whole;
    repeated rows stay as often as they are given; rows with a null doc_id are documents too; further columns don't matter
    and are dropped; an empty table gives no rows.
    """
    return line_rules.clean(only(docs, *COLUMNS), Scratch(spark, "stage-quality"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learned languages, go.

    Null and empty texts go; a null lang isn't learned from, but predicted; ties go to the first language; repeated rows and
    rows with a null doc_id are judged by their texts; further columns are dropped; an empty table gives no rows. If no row
    has a lang, nothing is known of any language and all documents go.
    """
    docs = only(docs, *COLUMNS)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    langs, table = language.learn(spark, docs.where(~held_out))
    seen = language.identify(spark, docs, langs, table)
    rejected = Scratch(spark, "stage-language").write(seen.where((F.col("lang_pred") == "und") | (F.col("coverage") < MIN_COVERAGE)).select("doc_id", "text_key"), "rejected")
    return without(docs.withColumn("text_key", F.xxhash64("text")), rejected, ["doc_id", "text_key"]).drop("text_key")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id. Other texts of a doc_id are
    documents of their own.

    Texts without words are no copies of anything and stay; rows that repeat both doc_id and text become one, that with the
    smallest other columns; a null doc_id stays only where its group has no other; further columns are dropped; an empty
    table gives no rows.
    """
    docs = only(docs, *COLUMNS)
    scratch = Scratch(spark, "stage-near")
    rows = with_text(docs)
    if ngram_join.unique_ids(rows):
        verdict = scratch.write(ngram_join.join_components(spark, docs, scratch), "verdict")
        return without(docs, verdict.where("component_id <> doc_id"), ["doc_id"])
    table = ngram_join.text_components(spark, rows, scratch)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    stays = table.groupBy("component").agg(F.min(order)["node"].alias("stays"))
    verdict = scratch.write(table.join(stays, "component").where("node <> stays").select("node"), "verdict")
    left = without(docs.withColumn("node", ngram_join.text_node()), verdict, ["node"])
    return left.groupBy("node").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that occur more than once are cut out of the texts; all documents stay.

    A document all of whose words are in such windows keeps its row with an empty text. Null and short texts stay as they
    are; rows that repeat a text lose its windows each; rows with a repeated or null doc_id are told apart by their words;
    further columns are dropped; an empty table gives no rows.
    """
    ship(spark)
    docs = only(docs, *COLUMNS)
    return substring_dedup.drop_spans(spark, docs, substring_dedup.repeated_spans(spark, with_text(docs), Scratch(spark, "stage-passages")))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences that fill windows of 2048 tokens.

    Null and empty texts are a piece with the end id alone; long texts are cut; repeated rows are packed each; a null doc_id
    is kept; further columns don't matter; an empty table gives no rows.
    """
    return packing.pack(spark, docs, public_tokenizers.path(TOKENIZER), keep="")


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", packed_sequences),
]
#: Language filters and packing have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, f"stage-{k}")
            scratch.drop(f"stage-{k - 1}")
    return docs
