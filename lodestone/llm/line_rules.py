"""Quality rules over lines: lines that many documents of a host share are removed, depleted documents are rejected.

DataFrame functions only. A host is a document's `source`. Lines are normalised (A-Z lower-cased, white space runs to one
space, digit runs to 0), hashed, and counted once for each document; counts are summed before they are shuffled, so a
line or host that holds a third of all rows costs one row for each task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE_CLASS, Scratch, only, same, without

MIN_WORDS = 50
#: A line is frequent on a host beyond this many documents and beyond this share of the host's documents.
LINE_DOCS, LINE_SHARE = 20, 0.01
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.3
SYMBOLS = "#*$%&|<>"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words that lie in 3-word windows which the text holds twice or more."""
    hashes = F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    )
    # Most texts have no window twice, which is found without sorting.
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_in_repeats(h)))


def _in_repeats(hashes: Column) -> Column:
    windows = F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    twice = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("p"))
    return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["p"])).cast("long").alias("n"), p.alias("p")), lambda a: a["n"])


def normal_line(line: Column) -> Column:
    lower = F.translate(line, string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(F.regexp_replace(lower, SPACE_CLASS + "+", " "), "[0-9]+", "0"))


def count_words(line: Column) -> Column:
    return F.size(words_of(line))


#: What a row is known by: doc_id, its host and the hash of its text.
KEYS = ("doc_id", "host", "text_key")
#: Places of frequent lines (and rows that have any) up to which they are broadcast; beyond, Spark shuffles both sides.
BROADCAST_PLACES = 1_000_000


def with_keys(docs: DataFrame) -> DataFrame:
    """`docs` with host (a null source is a host of its own) and text_key."""
    return docs.withColumn("host", F.coalesce(F.col("source").cast("string"), F.lit("\u0000null"))).withColumn("text_key", F.xxhash64(F.col("text").cast("string")))


def has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def lines_with_word(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), has_word)


def _rows(docs: DataFrame) -> DataFrame:
    rows = with_keys(only(docs, "doc_id", "source", "text"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "host", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "text_key")


def _per_doc(rows: DataFrame) -> DataFrame:
    """Every distinct normalised line of a document, with all its words there."""
    lines = rows.select(*KEYS, F.explode(lines_with_word(F.col("text"))).alias("line")).select(*KEYS, F.xxhash64(normal_line(F.col("line"))).alias("line"), count_words(F.col("line")).alias("words"))
    return lines.groupBy(*KEYS, "line").agg(F.sum("words").alias("words"))


def frequent_lines(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """host, line (hash): normalised lines above the limits."""
    rows = _rows(docs)
    hosts = rows.select(*KEYS).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))  # equal rows are one document, as in n_docs
    seen = _per_doc(rows).groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > line_docs)
    return seen.join(hosts, "host").where(F.col("n_docs") > F.lit(line_share) * F.col("host_docs")).select("host", "line")


def judged(docs: DataFrame, frequent: DataFrame, left_share: float = LEFT_SHARE) -> DataFrame:
    """The columns of line_rules, and host, for every row of `docs`."""
    rows = _rows(docs)
    words, text = F.col("words"), F.col("text")
    base = rows.select(*KEYS, "text", words_of(text).alias("words")).select(
        *KEYS,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\u000b\u000c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines_with_word(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
    )
    hit = _per_doc(rows).join(frequent, ["host", "line"]).groupBy(*KEYS).agg(F.sum("words").alias("all_words"), F.count("*").alias("n_frequent_lines"))
    # Equal rows lie together there: each has its share of the words.
    equal = rows.groupBy(*KEYS).agg(F.count("*").alias("rows"))
    hit = same(hit, equal, KEYS, "left").select(*KEYS, F.expr("all_words div rows").alias("n_frequent_words"), "n_frequent_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = same(base, hit, KEYS, "left").na.fill(0, ["n_frequent_words", "n_frequent_lines"]).withColumn("base_failed", failed)
    depleted = (F.col("n_words") - F.col("n_frequent_words")) < F.lit(left_share) * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def line_rules(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """One row per row of `docs` (doc_id, source, text): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_frequent_words, n_frequent_lines.

    Null texts have no words and fail the base rules; a null source is a host of its own; equal rows (doc_id, source, text) are
    one document of their host and of its lines; rows that repeat a doc_id with another text are documents of their own, and all rows have the frequent words of their own text each; lines without a
    word are never counted; an empty table gives no rows; further columns are ignored.
    """
    out = judged(docs, frequent_lines(docs, line_docs, line_share), left_share)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words", "n_frequent_lines", "text_key")


def clean(docs: DataFrame, scratch: Scratch, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """The kept rows of `docs` (doc_id, source, text, n_chars and further columns) without their lines above the limits:
    n_words less n_frequent_words words are left in each text. All else of a text, and texts without such lines, stay as
    they are.
    """
    frequent = scratch.write(frequent_lines(docs, line_docs, line_share), "frequent")
    verdict = scratch.write(judged(docs, frequent, left_share).where("not kept or n_frequent_lines > 0").select(*KEYS, "kept"), "verdict")
    kept = without(with_keys(docs), verdict.where("not kept"), list(KEYS))
    # Lines are made again only of texts that have frequent ones, and only the places of those are shuffled.
    listed = verdict.where("kept").select(*KEYS).distinct()
    few = listed.count() <= BROADCAST_PLACES
    lines = same(kept, F.broadcast(listed) if few else listed, KEYS, "left_semi").select(*KEYS, F.posexplode(F.split("text", "\n")).alias("place", "line")).where(has_word(F.col("line")))
    found = lines.select(*KEYS, "place", F.xxhash64(normal_line(F.col("line"))).alias("line")).join(frequent, ["host", "line"], "left_semi")
    places = scratch.write(found.groupBy(*KEYS).agg(F.sort_array(F.collect_set("place")).alias("places")), "places")
    few = (places.agg(F.sum(F.size("places") + 1)).first()[0] or 0) <= BROADCAST_PLACES
    joined = same(kept, F.broadcast(places) if few else places, KEYS, "left")
    gone = F.col("places")
    # The runs of lines between removed ones.
    run = lambda lines: lambda k: let(F.when(k == 0, -1).otherwise(F.get(gone, k - 1)), lambda a: F.slice(lines, a + 2, F.coalesce(F.get(gone, k), F.size(lines)) - a - 1))
    left = let(F.split("text", "\n"), lambda lines: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), run(lines))), "\n"))
    out = joined.withColumn("text", F.when(gone.isNull(), F.col("text")).otherwise(left))
    return out.withColumn("n_chars", F.when(gone.isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(*docs.columns)


LINE_RULES_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1) || 'null') AS source, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, source, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM b)),
r AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g), (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1 GROUP BY doc_id),
l AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(translate(x, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS line,
    len(list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '')) AS k FROM (SELECT doc_id, source, unnest(ls) AS x FROM b)),
p AS (SELECT doc_id, source, line, sum(k) AS k FROM l GROUP BY ALL),
h AS (SELECT source, count(*) AS host_docs FROM d GROUP BY source),
f AS (SELECT source, line FROM (SELECT source, line, count(*) AS n FROM p GROUP BY ALL) JOIN h USING (source) WHERE n > {LINE_DOCS} AND n > {LINE_SHARE} * host_docs),
x AS (SELECT doc_id, sum(k) AS fw, count(*) AS fl FROM p JOIN f USING (source, line) GROUP BY doc_id),
o AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(fw, 0)::BIGINT AS n_frequent_words, coalesce(fl, 0)::BIGINT AS n_frequent_lines
  FROM b LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bf AS base_failed, NOT bf AND NOT (n_words - n_frequent_words < {LEFT_SHARE} * n_words) AS kept, n_frequent_words, n_frequent_lines
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS bf FROM o)
"""
