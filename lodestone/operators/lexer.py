"""Tokens of source texts, and what their brackets enclose: pairs, scopes, functions and their bodies.

One pattern cuts a whole text into tokens without gaps, so the texts' places are running sums of the tokens' lengths. Depths are running sums of brackets, lifted
where more are closed than were open. A bracket closes the one opened last, of whatever kind; on one level opening and
closing take turns, so pairs are neighbours of a window over (file, level). What stands around a bracket is the last one opened a level
above before it: the same window once more, one level down. Nothing folds over growing arrays, and all windows are over one file's tokens.

Strings, templates and comments are tokens, so brackets in them don't count. Literals of regular expressions aren't known: their signs are tokens
of their own. A template is one token, whatever is inserted in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import cut

#: Kinds of tokens in the order in which they are tried; the last takes any character.
TOKENS = {
    "space": r"\s++",
    "comment": r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)",
    "string": r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|' + r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?|" + r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`?",
    "name": r"[\p{L}_$][\p{L}\p{N}_$]*+",
    "number": r"\d[\w.]*+",
    "open": r"[(\[{]",
    "close": r"[)\]}]",
    "sign": r"=>|(?s:.)",
}
TOKEN = "|".join(f"(?:{p})" for p in TOKENS.values())
#: Words before brackets that make no function of what follows.
CONTROL = ("if", "for", "while", "switch", "catch", "with", "return", "typeof", "await", "new", "do", "else", "function")


def kind_of(text: Column) -> Column:
    """The kind of a token that isn't white space or a comment."""
    first = F.substring(text, 1, 1)
    letter = first.between("a", "z") | first.between("A", "Z") | first.isin("_", "$") | ((first > "\x7f") & text.rlike(r"\A\p{L}"))
    return F.when(letter, "name").when(first.isin(*"([{"), "open").when(first.isin(*")]}"), "close").when(first.isin(*"\"'`"), "string").when(first.between("0", "9"), "number").otherwise("sign")


def tokens(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, at, i, line_no, kind, text, depth: the tokens that aren't white space or comments, numbered from 0 (`at`: with those); depth is that inside an opening bracket,
    and before a closing one is closed. `lone`: a closing bracket that nothing was open for.

    Null and empty texts have none. Very long texts are one row's array of tokens; windows spill.
    """
    each = files.select(F.col(path).alias("path"), F.posexplode(F.regexp_extract_all(F.col(content), F.lit(TOKEN), F.lit(0))).alias("at", "text"))
    order = Window.partitionBy("path").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first, text = F.substring("text", 1, 1), F.col("text")
    blank = first.isin(*" \t\n\x0b\f\r") | text.startswith("//") | text.startswith("/*")
    lines = F.when(text.contains("\n"), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).otherwise(0)
    step = F.when(first.isin(*"([{"), 1).when(first.isin(*")]}"), -1).otherwise(0)
    # White space without a line's end says nothing; the other counts lines only.
    solid = each.where(~blank | text.contains("\n")).select("path", "at", "text", lines.alias("lines"), step.alias("step"), F.when(blank, 0).otherwise(1).alias("solid"))
    solid = solid.select("*", F.sum("lines").over(so_far).alias("past"), F.sum("solid").over(so_far).alias("n"), F.sum("step").over(so_far).alias("sum")).where("solid = 1")
    before = F.least(F.min("sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = solid.select("path", "at", (F.col("n") - 1).cast("int").alias("i"), (F.col("past") - F.col("lines") + 1).cast("int").alias("line_no"), kind_of(text).alias("kind"), "text", "sum", before.alias("before"))
    lone = (F.col("kind") == "close") & (F.col("sum") < F.col("before"))
    depth = F.col("sum") - F.least("sum", "before") + F.when((F.col("kind") == "close") & ~lone, 1).otherwise(0)
    return known.select("path", "at", "i", "line_no", "kind", "text", depth.cast("int").alias("depth"), lone.alias("lone"))


def brackets(tokens_: DataFrame) -> DataFrame:
    """path, sign, start, end, level, around, start_line, end_line: pairs of brackets by their tokens' numbers; `around` is the opening one that holds it (null: none), and
    what is never closed has no end."""
    signs = tokens_.where("kind = 'open' or (kind = 'close' and not lone)").select("path", "i", "line_no", "kind", "text", F.col("depth").alias("level"))
    turn = Window.partitionBy("path", "level").orderBy("i")
    pairs = signs.withColumn("end", F.lead("i").over(turn)).withColumn("end_line", F.lead("line_no").over(turn)).where("kind = 'open'")
    inner = pairs.select("path", F.col("text").alias("sign"), F.col("i").alias("start"), "end", "level", F.col("line_no").alias("start_line"), "end_line")
    # Each stands twice in one table, on its own level and on the one above, so that the tokens are cut once.
    both = inner.select("*", F.explode(F.array(F.struct((F.col("level") - 1).alias("key"), F.lit(None).cast("int").alias("outer")), F.struct(F.col("level").alias("key"), F.col("start").alias("outer")))).alias("x")).select("*", "x.*")
    last = Window.partitionBy("path", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("around", F.last("outer", ignorenulls=True).over(last)).where("outer is null").select("path", "sign", "start", "end", "level", "around", "start_line", "end_line")


def neighbours(tokens_: DataFrame) -> DataFrame:
    """Tokens with the texts before and after them (b1 to b4, n1 and n2) and the kinds of those next to them (kb1, kn1)."""
    w = Window.partitionBy("path").orderBy("at")
    back = (F.lag("text", k).over(w).alias(f"b{k}") for k in (1, 2, 3, 4))
    return tokens_.select("*", *back, F.lead("text", 1).over(w).alias("n1"), F.lead("text", 2).over(w).alias("n2"), F.lag("kind", 1).over(w).alias("kb1"), F.lead("kind", 1).over(w).alias("kn1"))


def matched(near: DataFrame) -> DataFrame:
    """`neighbours` with what brackets know of each other. `end`, `end_line`, `after`: where an opening one is closed, and the token behind that.
    `opener`: the bracket that a closing one closes, with its neighbours. `head`, at the brace of a function's body: name, params, params_end. All of it is windows over one file's tokens, so
    tables dealt by path are neither written nor shuffled for it; tokens other than brackets may be left out before."""
    sign = (F.col("kind") == "open") | ((F.col("kind") == "close") & ~F.col("lone"))
    turn, w = Window.partitionBy("path", "level").orderBy("i"), Window.partitionBy("path").orderBy("i")
    opens, closes = F.col("kind") == "open", sign & (F.col("kind") == "close")
    t = near.withColumn("level", F.when(sign, F.col("depth")))
    next_ = lambda c: F.when(opens, F.lead(c).over(turn))
    opener = F.struct("i", "text", "b1", "b2", "b3", "kb1")
    t = t.select("*", next_("i").alias("end"), next_("line_no").alias("end_line"), next_(F.struct("n1", "kn1")).alias("after"), F.when(closes, F.lag(opener).over(turn)).alias("opener"))
    # What stands between the closing bracket and the brace: nothing, an arrow, or a type after a colon.
    arrow = F.col("b1") == "=>"
    ends = F.when(~arrow & (F.col("b1") == ")"), F.col("i") - 1).when(arrow & (F.col("b2") == ")"), F.col("i") - 2).when(~arrow & (F.col("b3") == ")") & (F.col("b2") == ":"), F.col("i") - 3)
    t = t.withColumn("params_end", F.when(F.col("text") == "{", ends))
    before = [F.lag(F.struct("i", "opener"), k).over(w) for k in (1, 2, 3)]
    t = t.withColumn("o", F.coalesce(*(F.when(b["i"] == F.col("params_end"), b["opener"]) for b in before)))
    named = (F.col("o.kb1") == "name") & ~F.col("o.b1").isin(*CONTROL)
    # name = (x) => {, name = async (x) => {, name: (x) => {
    given = F.when(F.col("o.b1").isin("=", ":"), F.col("o.b2")).when((F.col("o.b1") == "async") & F.col("o.b2").isin("=", ":"), F.col("o.b3"))
    name = F.when(arrow, F.coalesce(given, F.lit(""))).when(F.col("o.b1") == "function", "").when(named, F.col("o.b1"))
    head = F.when((F.col("o.text") == "(") & name.isNotNull(), F.struct(name.alias("name"), F.col("o.i").alias("params"), "params_end"))
    return t.withColumn("head", head).drop("o", "params_end")


def nested(ranges: DataFrame, value: Column) -> DataFrame:
    """Ranges (path, first, last: null for the file's end) that nest, with `depth` (0: outside all others) and `around`: `value` of the innermost one that holds each (null: none).

    One opens after those around it and closes before them, and where one ends as the next begins, the end comes first: what is around it is the last one opened on the level above."""
    columns = ranges.columns
    ends = F.explode(F.array_compact(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("step")), F.when(F.col("last").isNotNull(), F.struct(F.col("last").alias("at"), F.lit(-1).alias("step"))))))
    run = Window.partitionBy("path").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = ranges.select("*", value.alias("value"), ends.alias("e")).withColumns({"at": F.col("e.at"), "step": F.col("e.step")}).withColumn("depth", (F.sum("step").over(run) - 1).cast("int")).where("step = 1")
    both = levels.select(*columns, "depth", "value", F.explode(F.array(F.struct(F.lit(False).alias("opens"), F.col("depth").alias("key")), F.struct(F.lit(True).alias("opens"), (F.col("depth") + 1).alias("key")))).alias("x")).select("*", "x.*")
    last = Window.partitionBy("path", "key").orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = F.when(F.col("key") > 0, F.last(F.when(F.col("opens"), F.col("value")), ignorenulls=True).over(last))
    return both.withColumn("around", around).where("not opens").select(*columns, "depth", "around")


def functions(tokens_: DataFrame) -> DataFrame:
    """path, name, params, params_end, start, end, start_line, end_line, inside: functions, methods and arrow functions with a body in braces, by the
    numbers of their tokens: where the head's brackets are, and the body's. `inside` is the body's brace of the function around it. Names of arrows are those they are assigned to; others
    without a name have an empty one. They are written, as they are much fewer than the tokens they are found in."""
    found = matched(neighbours(tokens_).where("kind in ('open', 'close')")).where("head is not null").select("path", "head.*", F.col("i").alias("first"), F.col("end").alias("last"), F.col("line_no").alias("start_line"), "end_line")
    held = nested(found, F.col("first")).select("path", "name", "params", "params_end", F.col("first").alias("start"), F.col("last").alias("end"), "start_line", "end_line", F.col("around").alias("inside"))
    return cut(tokens_.sparkSession, held, apart=True)
