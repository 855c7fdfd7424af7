"""Spelling variants of a corpus vocabulary, found by wildcard groups and never by pairs of words.

Two words are near if one inserted, deleted or replaced character makes one of the other. Each word stands in one group
for each of its places: what is before the place, a wildcard, what is after it. Words of a group differ by one replacement,
and two words meet in one group only. A group holds one word for each letter of the alphabet at most (`LETTERS`: 90), so
its size and its two most frequent words are taken in one go: a member's best other is the first of them, or the second
where the first is itself. Words less one character join the vocabulary, which gives insertions and deletions. What a word
gets from its groups is summed (numbers of near words, the best of the bests); no step makes a row for each pair within a group.

Costs: the text is read once and words are counted where they are read, so the first shuffle has one row for each distinct
word and task. From then on everything grows with the vocabulary: twice its characters in rows of short strings, two shuffles.
Ways to the root are followed by pointer doubling; a form is at least `RATIO` times as frequent as its word, so a way of k
steps needs counts of RATIO^k, and rounds are the logarithm of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, with_text

LETTERS = "a-zA-Z\\u00C0-\\u00FF"
#: Words have this many characters and occurrences at least; a form is RATIO times as frequent as its word.
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a character, chosen by document and run.
SLIP = 199
#: Isn't a letter, so it marks the place in a group's key.
WILD = "*"


def without_at(word: Column, at: Column, filler: str = "") -> Column:
    """`word` with its character at the place `at` (from 0) replaced by `filler`."""
    return F.concat(F.substring(word, F.lit(1), at), F.lit(filler), F.substring(word, at + 2, F.length(word)))


def word_counts(docs: DataFrame, slip: int | None = SLIP, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): letter runs of all texts of `docs` (doc_id, text), A to Z lower-cased, one in `slip` less a character."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = with_text(docs).select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("word"))
    if slip:
        mark = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        runs = runs.withColumn("mark", mark).withColumn("word", F.when(F.col("mark") % slip == 0, without_at(F.col("word"), (F.col("mark") % F.length("word")).cast("int"))).otherwise(F.col("word")))
        runs = runs.where(F.length("word") >= min_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _at_all_places(make) -> Column:
    return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.length("word") - 1), make)))


def _rated(n: Column, word: Column) -> Column:
    """Smallest for the largest n, and of equals for the first word in code-point order."""
    return F.struct((-n).alias("less"), word.alias("word"))


def replaced(words: DataFrame) -> DataFrame:
    """(word, near, best): for each word and group that holds others, how many and the best of them."""
    places = words.select("word", "n", _at_all_places(lambda i: without_at(F.col("word"), i, WILD)).alias("group"))
    groups = places.groupBy("group").agg(F.sort_array(F.collect_list(_rated(F.col("n"), F.col("word")))).alias("members")).where(F.size("members") > 1)
    kept = groups.select((F.size("members") - 1).cast("long").alias("near"), F.col("members")[0].alias("first"), F.col("members")[1].alias("second"), F.explode("members.word").alias("word"))
    return kept.select("word", "near", F.when(F.col("word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))


def cut(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, near, best): words that are others less one character, and those others."""
    places = words.where(F.length("word") > min_length).select(F.col("word").alias("longer"), F.col("n").alias("longer_n"), _at_all_places(lambda i: without_at(F.col("word"), i)).alias("word"))
    met = places.join(words, "word").select("word", "n", "longer", "longer_n")
    shorter = met.select("word", F.lit(1).cast("long").alias("near"), _rated(F.col("longer_n"), F.col("longer")).alias("best"))
    return shorter.unionByName(met.select(F.col("longer").alias("word"), F.lit(1).cast("long").alias("near"), _rated(F.col("n"), F.col("word")).alias("best")))


def near_words(words: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word of `words` (word, n)."""
    alone = words.select("word", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less: bigint, word: string>").alias("best"), "n")
    parts = replaced(words).unionByName(cut(words, min_length)).withColumn("n", F.lit(None).cast("long"))
    merged = alone.unionByName(parts).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    return merged.select("word", "n", "n_near", F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))


def roots(near: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the words that have a form: the last word on the way from form to form."""
    ways = scratch.write(near.where("form is not null").select("word", F.col("form").alias("root")), "ways-0")
    k = 0
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        k += 1
        ways = scratch.write(ways.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"ways-{k}")
        scratch.drop(f"ways-{k - 1}")
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.drop("moved")


def spelling_variants(spark: SparkSession, docs: DataFrame, slip: int | None = SLIP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least MIN_LENGTH characters and MIN_COUNT occurrences.

    Null and empty texts have no words; a text without white space or letters likewise; long texts are taken whole. Repeated
    rows count each. A null doc_id counts as an empty one in the choice of runs that lose a character. Of near words with
    equal n the first in code-point order is the form. Further columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark, "spelling")
    words = scratch.write(word_counts(docs, slip), "words")
    near = scratch.write(near_words(words), "near")
    found = near.join(roots(near, scratch), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return found


#: The same by pairs of words, for the standard table.
SPELLING_SQL = """
with recursive bits as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as crc
), runs as (
  select doc_id, run, count(*) as times from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zA-Z\\x{00C0}-\\x{00FF}]+')) as run from documents)
  where length(run) >= 6 group by doc_id, run
), marked as (
  select run, times, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda s: case when unicode(s) < 128 then [unicode(s)::bigint] else [195::bigint, unicode(s)::bigint - 64] end))),
    lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]))) as mark
  from runs, bits
), words as (
  select word, sum(times)::bigint as n from (
    select case when mark % 199 = 0 then substring(run, 1, mark % length(run)) || substring(run, mark % length(run) + 2) else run end as word, times from marked)
  where length(word) >= 6 group by word having sum(times) >= 5
), places as (
  select word, n, i, substring(word, 1, i) as before, substring(word, i + 2) as after from (select word, n, unnest(range(length(word))) as i from words)
), pairs as (
  select a.word, a.n, b.word as other, b.n as other_n from places a join places b on a.i = b.i and a.before = b.before and a.after = b.after and a.word <> b.word
  union select w.word, w.n, p.word, p.n from places p join words w on w.word = p.before || p.after
  union select p.word, p.n, w.word, w.n from places p join words w on w.word = p.before || p.after
), ranked as (
  select word, n, other, other_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by other_n desc, other) as place from pairs
), near as (
  select w.word, w.n, coalesce(r.n_near, 0) as n_near, case when r.other_n >= 5 * w.n then r.other end as form, case when r.other_n >= 5 * w.n then r.other_n end as form_n
  from words w left join ranked r on r.word = w.word and r.place = 1
), ways as (
  select word, word as here, 0 as steps from near
  union all select ways.word, near.form, steps + 1 from ways join near on near.word = ways.here where near.form is not null
)
select near.word, near.form, e.root, near.n, near.n_near, near.form_n
from near join (select word, arg_max(here, steps) as root from ways group by word) e on e.word = near.word
"""
