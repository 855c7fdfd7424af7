"""Symbols with their ranges and parents: by brackets where bodies stand in braces, by indentation where they don't.

Kinds of declarations are words of the languages. With braces, a declaration's body is the first brace opened after it on its own level
before the statement ends; methods without a word of their own are the functions that `lexer` finds. With indentation, a body ends before the next line that is
indented as little as its head: each line ends the bodies of all levels from its own on, so one window over (file, level) finds the ends. A parent is the innermost symbol around.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import extension, split_lines
from lodestone.operators import lexer
from lodestone.sources.tables import cut

# Extensions of languages with braces, and the words that declare.
BRACES = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "java", "kt", "kts", "go", "rs", "c", "h", "cpp", "cc", "hpp", "cs", "php", "swift", "scala")
INDENTED = ("py", "pyw")
TYPES = ("class", "interface", "enum", "struct", "trait", "impl", "namespace", "object", "protocol", "extension", "record", "union")
FUNCS = ("func", "fn", "fun", "function", "def")


def brace_symbols(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, kind, name, start_line, end_line, first, last: declarations with a body in braces, by the numbers of their tokens. Windows over a file's tokens find them, without a join: files dealt by path
    stay where they are."""
    t = lexer.neighbours(lexer.tokens(files.where(extension(F.col(path)).isin(*BRACES)), path, content))
    word = (F.col("kind") == "name") & F.col("text").isin(*TYPES, *FUNCS) & (F.coalesce("b1", F.lit("")) != ".")
    t = lexer.matched(t.withColumn("word", word).where("word or kind in ('open', 'close') or text = ';'"))
    # Go names a method after its receiver, in brackets: those are the next row after its word then.
    behind = F.lead(F.when((F.col("text") == "(") & F.col("end").isNotNull(), F.col("after"))).over(Window.partitionBy("path").orderBy("i"))
    t = t.withColumn("behind", behind)
    name = F.when((F.col("n1") == "(") & (F.col("text") == "func") & (F.col("behind.kn1") == "name"), F.col("behind.n1")).when(F.col("kn1") == "name", F.col("n1"))
    declares = F.struct(F.when(F.col("text").isin(*FUNCS), "function").otherwise(F.col("text")).alias("kind"), name.alias("name"), F.col("line_no").alias("start_line"))
    marks = t.withColumn("declares", F.when(F.col("word") & name.isNotNull(), declares)).where("declares is not null or text in ('{', ';')")
    # On each level: heads, braces and ends of statements in order; a head's body is what comes next, if that is a brace.
    turn = Window.partitionBy("path", "level").orderBy("i")
    marks = marks.withColumn("level", F.col("depth") - (F.col("text") == "{").cast("int")).withColumn("declared", F.lag("declares").over(turn)).where("text = '{'")
    method = F.when((F.col("head.name") != "") & ~F.col("head.name").isin(*FUNCS), F.struct(F.lit("function").alias("kind"), F.col("head.name").alias("name"), F.col("line_no").alias("start_line")))
    return marks.withColumn("x", F.coalesce("declared", method)).where("x is not null").select("path", "x.*", "end_line", F.col("i").alias("first"), F.col("end").alias("last"))


def indented_symbols(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, kind, name, start_line, end_line, first, last: classes and functions by indentation (tabs count to the next multiple of eight). Blank lines, and lines of comments alone, end
    nothing; a body's last line is its last one that isn't blank."""
    each = files.where(extension(F.col(path)).isin(*INDENTED)).select(F.col(path).alias("path"), F.posexplode(split_lines(F.col(content))).alias("line_no", "text"))
    solid = each.where(~F.col("text").rlike(r"^\s*(?:#.*)?$")).withColumn("line_no", F.col("line_no") + 1)
    head = F.regexp_extract("text", r"^[ \t]*", 0)
    indent = F.length(F.regexp_replace(head, r"\t", " " * 8))
    rows = solid.select("path", "line_no", indent.alias("indent"), F.regexp_extract("text", r"^\s*(?:async\s+)?(class|def)\s+(\w+)", 1).alias("word"), F.regexp_extract("text", r"^\s*(?:async\s+)?(class|def)\s+(\w+)", 2).alias("name"))
    rows = rows.withColumn("before", F.lag("line_no").over(Window.partitionBy("path").orderBy("line_no")))
    levels = rows.where("word <> ''").select("path", F.col("indent").alias("level")).distinct()
    ends = rows.join(levels.hint("merge"), "path").where("indent <= level").select("path", "level", "line_no", "before", "indent", "word", "name")
    turn = Window.partitionBy("path", "level").orderBy("line_no")
    final = rows.groupBy("path").agg(F.max("line_no").alias("final"))
    found = ends.withColumn("end_line", F.lead("before").over(turn)).where("word <> '' and indent = level").join(final.hint("merge"), "path")
    end = F.coalesce("end_line", "final")
    return found.select("path", F.when(F.col("word") == "class", "class").otherwise("function").alias("kind"), "name", F.col("line_no").cast("int").alias("start_line"), end.cast("int").alias("end_line"), F.col("line_no").cast("int").alias("first"), (end + 1).cast("int").alias("last"))


def nested_symbols(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, kind, name, start_line, end_line, parent, depth: all symbols; `parent` is the innermost symbol around, by name (null: none), depth 0 outside all.

    Symbols are written once, at the end: nothing of the tokens is."""
    found = [lexer.nested(d, F.col("name")) for d in (brace_symbols(files, path, content), indented_symbols(files, path, content))]
    both = found[0].unionByName(found[1]).select("path", "kind", "name", "start_line", "end_line", F.col("around").alias("parent"), "depth")
    return cut(files.sparkSession, both)
