"""Finding what patterns can match, by literals: one automaton for all rules of a scan, and posting tables of trigrams for search.

Every pattern is turned into a set of literals of which each of its matches holds one (lower-cased). A scan runs one automaton of
all rules' literals over each text, once, whatever the number of rules; only lines with a literal go on, with the rules
that it speaks for, and only those rules' patterns are tried there. Rules without a literal are tried on all lines.

For search, `postings` has a row for each file and trigram of its lower-cased text, with the number of times it stands there. A literal's files are those that
have all its trigrams as often as the literal has. `upsert` replaces the rows of changed files and drops those of removed ones.
"""

from __future__ import annotations

import re
import re._constants as kinds
import re._parser as parser
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import extension
from lodestone.operators.scan import Rule
from lodestone.operators.search import search

#: Most literals of a pattern, and the shortest that is looked for.
MOST, SHORTEST = 128, 2
#: Bits of a character in a trigram's code.
BITS = 21
POSTINGS = "path string, gram long, n int"


def _class(members) -> set[str] | None:
    """The characters of a class, if they are few."""
    out: set[str] = set()
    for kind, value in members:
        if kind is kinds.LITERAL:
            out.add(chr(value).lower())
        elif kind is kinds.RANGE and value[1] - value[0] < 16:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        elif kind is kinds.CATEGORY and value is kinds.CATEGORY_DIGIT:
            out |= set("0123456789")
        else:
            return None
    return out


def _strings(items) -> set[str] | None:
    """All texts that a part of a pattern can stand for, if they are few."""
    out = {""}
    for kind, value in items:
        if kind is kinds.LITERAL:
            more = {chr(value).lower()}
        elif kind is kinds.IN:
            more = _class(value)
        elif kind is kinds.SUBPATTERN:
            more = _strings(value[3])
        elif kind is kinds.BRANCH:
            each = [_strings(b) for b in value[1]]
            more = None if None in each else set().union(*each)
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[1] == 1:
            more = _strings(value[2])
            more = more if more is None or value[0] else more | {""}
        elif kind is kinds.AT or kind in (kinds.ASSERT, kinds.ASSERT_NOT):
            more = {""}
        else:
            return None
        if more is None or len(out) * len(more) > MOST:
            return None
        out = {a + b for a in out for b in more}
    return out


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set that is rarer found: the longer shortest literal, up to six characters, then fewer literals."""
    sets = [x for x in (a, b) if x and all(len(t) >= SHORTEST for t in x)]
    return max(sets, key=lambda x: (min(6, min(map(len, x))), -len(x)), default=None)


def _needed(items) -> set[str] | None:
    best, run = None, []
    for item in items:
        if _strings([*run, item]) is not None:
            run.append(item)
            continue
        kind, value = item
        if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] and _strings(value[2]) is not None:
            # Something repeated begins and ends with itself, twice where it stands twice at least.
            once = list(value[2]) * (2 if value[0] > 1 and _strings(list(value[2]) * 2) is not None else 1)
            best = _better(_better(best, _strings(run)), _strings([*run, *once]))
            run = once
            continue
        best = _better(best, _strings(run))
        run = [item] if _strings([item]) is not None else []
        inner = None
        if kind is kinds.SUBPATTERN:
            inner = _needed(value[3])
        elif kind is kinds.BRANCH:
            each = [_needed(b) for b in value[1]]
            inner = None if None in each else set().union(*each)
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0]:
            inner = _needed(value[2])
        best = _better(best, inner)
    return _better(best, _strings(run))


def needed_literals(pattern: str) -> set[str] | None:
    """Lower-cased literals of which every match of the pattern, lower-cased, holds one; None if there are none of use."""
    # Flags in the middle of a pattern are for Java; what they change is how texts are compared, and all are lower-cased here.
    found = _needed(parser.parse(re.sub(r"\(\?[a-z]+\)", "", pattern)))
    # One that holds another says nothing more.
    return found and {t for t in found if not any(o != t and o in t for o in found)}


def automaton(rules: list[Rule]) -> tuple[ahocorasick.Automaton | None, list[int]]:
    """Literal -> numbers of the rules that need one of them; and the rules without literals."""
    of: dict[str, list[int]] = {}
    free = []
    for k, r in enumerate(rules):
        found = needed_literals(r.pattern)
        for t in found or ():
            of.setdefault(t, []).append(k)
        if not found:
            free.append(k)
    if not of:
        return None, free
    out = ahocorasick.Automaton()
    for t, ks in of.items():
        out.add_word(t, (len(t), ks))
    out.make_automaton()
    return out, free


#: Characters of texts whose lines are looked at together, if there are several texts.
TOGETHER = 1_000_000


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in order, in parts of TOGETHER bytes of the column's texts, or of one row that has more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > TOGETHER:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


CANDIDATES = "path string, line_no int, text string, ext string, rules array<int>"


def candidate_lines(files: DataFrame, rules: list[Rule], path: str = "path", content: str = "content") -> DataFrame:
    """path, line_no, text, ext, rules: the lines on which a rule may match, and the numbers of those rules, which are for the file's extension.

    Null contents have no lines. Texts are taken whole; memory is that of a batch as it comes, and of the lines of TOGETHER bytes of texts or of one text.
    """
    allowed = [set(r.extensions) for r in rules]
    patterns = [r for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search_, free = automaton(patterns)
        for b in (x for whole in batches for x in _slices(whole, 1)):
            cols: list[list] = [[] for _ in range(5)]
            for where, text, ext in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if text is None:
                    continue
                low = text.lower()
                if len(low) != len(text):  # a letter whose lower case is longer
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                found: dict[int, set[int]] = {}
                always = [k for k in free if not allowed[k] or ext in allowed[k]]
                lines = None
                if search_ is not None:
                    ends = [(end, ks) for end, (_, all_) in search_.iter(low) if (ks := [k for k in all_ if not allowed[k] or ext in allowed[k]])]
                    if ends:
                        lines = text.split("\n")
                        stops = np.cumsum([len(x) + 1 for x in lines])
                        for i, (_, ks) in zip(np.searchsorted(stops, [e for e, _ in ends], side="right").tolist(), ends, strict=True):
                            found.setdefault(i, set()).update(ks)
                if always:
                    lines = lines or text.split("\n")
                    for i in range(len(lines)):
                        found.setdefault(i, set()).update(always)
                for i, ks in found.items():
                    for c, v in zip(cols, (where, i + 1, lines[i], ext, sorted(ks)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32())), strict=True)], ["path", "line_no", "text", "ext", "rules"])

    rows = files.select(F.col(path).cast("string").alias("path"), F.col(content).cast("string").alias("content"), extension(F.col(path)).alias("ext"))
    return rows.mapInArrow(run, CANDIDATES)


def scan_indexed(files: DataFrame, rules: list[Rule], path: str = "path", content: str = "content") -> DataFrame:
    """path, line_no, text, rule_id, severity, category, confidence, cwe: the rows that trying every rule on every line gives.

    The automaton's rows go to the JVM, where one arm of a choice by the rule's number tries that rule's pattern. Nothing is shuffled.
    """
    each = candidate_lines(files, rules, path, content).select("path", "line_no", "text", F.explode("rules").alias("k"))
    text, ok = F.col("text"), F.lit(False)
    hit: Column | None = None
    for k, r in enumerate(rules):
        ok = text.rlike(r.pattern)
        if r.exclude:
            ok = ok & ~text.rlike(r.exclude)
        hit = F.when(F.col("k") == k, ok) if hit is None else hit.when(F.col("k") == k, ok)
    if hit is None:
        hit = F.lit(False)
    facts = F.get(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in (("rule_id", r.id), ("severity", r.severity), ("category", r.category), ("confidence", r.confidence), ("cwe", r.cwe)))) for r in rules)), F.col("k")) if rules else None
    found = each.where(hit)
    return found.select("path", "line_no", "text", facts.alias("m")).select("path", "line_no", "text", "m.*") if rules else found.select("path", "line_no", "text")


def trigram_codes(text: str) -> np.ndarray:
    """Codes of all trigrams of characters of a text, in order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:] if len(c) > 2 else np.zeros(0, np.int64)


def postings(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, gram, n: how often each trigram stands in a file's lower-cased (A to Z) text. Null and short contents have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                codes = [np.unique(trigram_codes(t or ""), return_counts=True) for t in part.column(1).to_pylist()]
                owner = np.repeat(np.arange(part.num_rows), [len(c) for c, _ in codes])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(np.concatenate([c for c, _ in codes])), pa.array(np.concatenate([n for _, n in codes]).astype(np.int32))], ["path", "gram", "n"])

    lowered = F.translate(F.col(content).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return files.select(F.col(path).cast("string").alias("path"), lowered.alias("content")).mapInArrow(run, POSTINGS)


def upsert(index: DataFrame, changed: DataFrame, removed: DataFrame | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """The index after files (path, content) have new contents, and files (path) have gone. Only changed files are read."""
    gone = changed.select(F.col(path).cast("string").alias("path"))
    if removed is not None:
        gone = gone.unionByName(removed.select(F.col(path).cast("string").alias("path")))
    return index.join(gone.distinct(), "path", "left_anti").unionByName(postings(changed, path, content))


def files_with(index: DataFrame, literal: str) -> DataFrame:
    """path of the files that have every trigram of the literal (any case) as often as it has; for one shorter than a trigram, all."""
    low = literal.translate({c: c + 32 for c in range(65, 91)})
    grams = Counter(trigram_codes(low).tolist())
    if not grams:
        return index.select("path").distinct()
    enough = F.lit(False)
    for g, n in grams.items():
        enough = enough | ((F.col("gram") == g) & (F.col("n") >= n))
    return index.where(F.col("gram").isin(*grams) & enough).groupBy("path").agg(F.count("*").alias("have")).where(F.col("have") == len(grams)).select("path")


def search_indexed(files: DataFrame, index: DataFrame, literal: str, path: str = "path", content: str = "content", **options) -> DataFrame:
    """What `search` finds for a literal, reading only the contents of files that the index names. One shorter than a trigram is looked
    for in all files, as the shortest files have no trigrams."""
    if len(literal) < 3:
        return search(files, literal, path, content, **options)
    named = files_with(index, literal).withColumnRenamed("path", "_named")
    kept = files.join(named, F.col(path).cast("string") == F.col("_named"), "left_semi")
    return search(kept, literal, path, content, **options)
