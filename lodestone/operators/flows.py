"""Where input from outside goes: variables, functions and files as one graph of flows, walked to a fixpoint.

All of it comes from the token table, of which only the few tokens that matter (`facts`) are written. A statement is what stands on a line between semicolons. Names are resolved to the innermost scope around
their use that declares them, else to the file's. What a statement's value holds (a variable, a source, the result of a call)
flows to what stands innermost around it: into the parameter of a function that is known, in this file or by an import; into a sink; nowhere, if it is a cleaner's argument;
else to the variable that is assigned, or to the result of the function that returns it.

Functions are summed up first: which parameters reach the result, through what stands in the function and the summaries of what it calls, to a
fixpoint. A call's result then holds those of its own arguments, and not what other calls bring. Sources spread along the edges: up from results to
calls, then down into parameters, from where only a variable of a scope around leads up again. Each thing keeps the first source by path and line;
a round is a join of what changed.

Not seen: order of statements, properties, names taken apart in braces, templates' insertions, values that go on over lines, calls of methods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import lexer
from lodestone.sources.tables import cut

#: Owners and members that bring input; functions by the kind of harm; functions that clean.
SOURCES = (("req", "request", "ctx"), ("query", "body", "params", "headers", "cookies"))
SINKS = {"sql": ("query", "execute", "raw"), "command": ("exec", "execSync", "spawn"), "code": ("eval",), "path": ("readFile", "readFileSync", "writeFile", "unlink", "sendFile"), "redirect": ("redirect",), "request": ("fetch", "axios", "got"), "page": ("write", "send")}
CLEANERS = ("escape", "sanitize", "encodeURIComponent", "parseInt", "Number", "basename")
DECLARES = ("const", "let", "var")
KEYWORDS = (*lexer.CONTROL, *DECLARES, "import", "export", "from", "as", "default", "class", "extends", "true", "false", "null", "undefined", "async", "of", "in", "case", "break", "throw", "try", "finally", "this")
#: The scope of a whole file.
FILE = -1


def innermost(tokens_: DataFrame, regions: DataFrame) -> DataFrame:
    """Tokens with `region`: the `id` of the innermost of the nested regions (path, first, last, id) that holds them, both ends left out; a missing end is the file's. Regions are
    brackets of their own: the last one opened on the level where a token stands, by a window over (file, level). An `id` may be of any type that has an order."""
    ends = regions.select("path", F.col("first").alias("i"), F.lit(1).alias("step"), F.col("id")).unionByName(regions.where("last is not null").select("path", F.col("last").alias("i"), F.lit(-1).alias("step"), F.lit(None).cast(regions.schema["id"].dataType).alias("id")))
    marks = ends.groupBy("path", "i").agg(F.sum("step").alias("step"), F.max("id").alias("id")).withColumn("opens", F.lit(True))
    # Marks stand before their tokens in one table, so files are dealt once and no join moves tokens.
    rows = tokens_.unionByName(marks, allowMissingColumns=True)
    run = Window.partitionBy("path").orderBy("i", F.col("opens").isNull())
    level = F.sum(F.coalesce("step", F.lit(0))).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begins = F.col("opens").isNull() & (F.lag("i").over(run) == F.col("i")) & F.lag("id").over(run).isNotNull()
    both = rows.withColumn("key", level - F.coalesce(begins, F.lit(False)).cast("int")).where("opens is null or id is not null")
    last = Window.partitionBy("path", "key").orderBy("i", F.col("opens").isNull().desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("region", F.when(F.col("key") > 0, F.last("id", ignorenulls=True).over(last))).where("opens is null").select(*tokens_.columns, "region")


def _node(*parts) -> Column:
    return F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts))


#: What a token may be, each a bit of its `flags`.
FLAGS = ("sets", "returns", "declares", "listed", "used", "source", "called", "member", "comma", "imports", "origin", "brought")


def is_any(*names: str) -> Column:
    return F.col("flags").bitwiseAND(sum(1 << FLAGS.index(n) for n in names)) != 0


def facts(files: DataFrame, sources: tuple = SOURCES) -> DataFrame:
    """The tokens that flows are made of, by windows over one file's tokens: names that declare, are declared, set, used or called, sources, `return`, what imports say, commas
    in brackets, and the braces of functions' bodies (`head`: name, params, params_end). `target`: the token that sets what the statement's values go to; `end`: where a body or a call's brackets end."""
    owners, members = sources
    w = Window.partitionBy("path").orderBy("at")
    so_far = Window.unboundedPreceding, Window.currentRow
    t = lexer.neighbours(lexer.tokens(files))
    text, p1, n1, n2 = (F.coalesce(c, F.lit("")) for c in ("text", "b1", "n1", "n2"))
    word, bracket = F.col("kind") == "name", F.col("kind").isin("open", "close")
    t = t.withColumn("name", word & ~text.isin(*KEYWORDS))
    name = F.col("name")
    is_source = text.isin(*owners) & (n1 == ".") & n2.isin(*members) & (p1 != ".")
    flags = {
        "sets": name & ~p1.isin("=", "!", "<", ">", "+", "-", "*", "/", "|", "&", "?", ".") & (n1 == "=") & (n2 != "="),
        "returns": text == "return",
        "declares": name & p1.isin(*DECLARES),
        "listed": name & p1.isin("(", ","),
        "used": name & (p1 != ".") & ~n1.isin("(", ":") & ~is_source,
        "source": is_source,
        "called": word & (n1 == "(") & (p1 != "function"),
        "member": p1 == ".",
        "comma": text == ",",
        "imports": text == "import",
        "origin": (F.col("kind") == "string") & (p1 == "from"),
        "brought": word & p1.isin("{", ",") & n1.isin("}", ","),
    }
    assert tuple(flags) == FLAGS
    packed = F.lit(0)
    for k, f in enumerate(flags.values()):
        packed = packed + F.when(f, 1 << k).otherwise(0)
    # Only brackets are asked later what stood before them.
    t = t.select("path", "at", "i", "line_no", "kind", "text", "depth", "lone", packed.alias("flags"), *(F.when(bracket, F.col(b)).alias(b) for b in ("b1", "b2", "b3", "kb1")), F.lit(None).cast("string").alias("n1"), F.lit(None).cast("string").alias("kn1"))
    t = t.where(is_any(*(f for f in FLAGS if f != "member")) | F.col("kind").isin("open", "close") | (F.col("text") == ";"))
    new = (F.col("text") == ";") | (F.lag("line_no").over(w) != F.col("line_no"))
    t = t.withColumn("statement", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w.rowsBetween(*so_far)).cast("int"))
    # The first thing of a statement that takes a value: what is set, or the function's result.
    earlier = F.max(F.when(is_any("sets", "returns"), F.col("statement"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("aims", is_any("sets", "returns") & F.coalesce(earlier < F.col("statement"), F.lit(True)))
    t = t.withColumn("aim", F.last(F.when(F.col("aims"), F.struct("statement", "i", (F.col("i") + is_any("sets").cast("int")).alias("after"))), ignorenulls=True).over(w.rowsBetween(*so_far)))
    t = t.withColumn("target", F.when((F.col("aim.statement") == F.col("statement")) & (F.col("i") > F.col("aim.after")), F.col("aim.i"))).drop("aim").where("text <> ';'")
    t = lexer.matched(t)
    by = Window.partitionBy("path").orderBy("i")
    step = F.when(F.col("text") == "(", 1).when(F.col("opener.text") == "(", -1).otherwise(0)
    t = t.withColumn("inside", F.sum(step).over(by.rowsBetween(*so_far)) > 0).withColumn("end", F.when(is_any("called"), F.lead("end").over(by)).otherwise(F.col("end")))
    other = F.col("aims") | is_any("declares", "called", "imports", "origin", "brought")
    thing = is_any("used", "source")
    t = t.where(other | (thing & F.col("target").isNotNull()) | (F.col("inside") & is_any("used", "source", "listed", "comma")) | F.col("head").isNotNull())
    return t.select("path", "i", "line_no", "statement", "text", "depth", "flags", "aims", "target", "end", "head")


def flow_graph(spark: SparkSession, files: DataFrame, sources: tuple = SOURCES, sinks: dict[str, tuple[str, ...]] | None = None, cleaners: tuple[str, ...] = CLEANERS) -> DataFrame:
    """kind, src, dst, call: flows between things named `path|scope|name`, `path|body|->` (a function's result), `path|token|()` (a call's result),
    `path|line|!kind` (a sink) and `path|line|?` (a source). Kinds: within (a function), out (into a variable of a scope around), up (a function's result into a call), down (an argument of
    `call` into a parameter)."""
    sinks = SINKS if sinks is None else sinks
    kept = lambda d: cut(spark, d, apart=True)
    found = kept(facts(files, sources))
    made = found.where("head is not null").select("path", "head.*", F.col("i").alias("first"), F.col("end").alias("last"))
    made = kept(lexer.nested(made, F.col("first")).select("path", "name", "params", "params_end", F.col("first").alias("start"), F.col("last").alias("end"), F.col("around").alias("inside")))
    t = innermost(found.where("head is null").drop("head"), made.select("path", F.col("params").alias("first"), F.col("end").alias("last"), F.struct("start", "params", "params_end").alias("id")))
    # Names: where they are declared, and what they mean where they are used. A parameter's place is the number of commas before it in its function's brackets.
    t = t.withColumn("scope", F.coalesce("region.start", F.lit(FILE))).withColumn("listing", F.coalesce((F.col("i") > F.col("region.params")) & (F.col("i") < F.col("region.params_end")), F.lit(False)))
    commas = F.sum((is_any("comma") & F.col("listing")).cast("int")).over(Window.partitionBy("path", "scope").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = kept(t.withColumn("place", commas.cast("int")).drop("region"))
    params = t.where(is_any("listed") & F.col("listing")).select("path", "scope", "text", "place")
    declared = t.where(is_any("declares") | (is_any("listed") & F.col("listing"))).select("path", "scope", "text").distinct()
    outer = made.select("path", F.col("start").alias("scope"), F.coalesce("inside", F.lit(FILE)).alias("above"))
    chain = kept(t.select("path", "scope").distinct().select("path", "scope", F.col("scope").alias("holder"), F.lit(0).alias("steps")))
    all_, k = chain, 0
    while True:
        k += 1
        chain = kept(chain.join(outer.select("path", F.col("scope").alias("holder"), "above"), ["path", "holder"]).select("path", "scope", F.col("above").alias("holder"), F.lit(k).alias("steps")))
        if chain.isEmpty():
            break
        all_ = all_.unionByName(chain)
    meant = declared.withColumnRenamed("scope", "holder").join(all_, ["path", "holder"]).groupBy("path", "scope", "text").agg(F.min_by("holder", "steps").alias("holder"))
    meant = kept(meant)

    # Functions by name: those of the file, by the scope that holds them, and those imported from others.
    own = made.where("name <> ''").select("path", F.col("name").alias("text"), F.coalesce("inside", F.lit(FILE)).alias("holder"), F.col("start").alias("body"))
    spec = F.regexp_extract("text", "^.(.*).$", 1)
    start = t.where(is_any("imports")).select("path", "statement").distinct()
    where = t.where(is_any("origin")).select("path", "statement", spec.alias("spec")).where("spec like './%'")
    folder = F.regexp_replace("path", "[^/]*$", "")
    where = where.select("path", "statement", F.concat(folder, F.substring("spec", 3, 1000), F.lit("."), F.regexp_extract("path", "[^.]*$", 0)).alias("from"))
    imported = t.where(is_any("brought")).join(start, ["path", "statement"]).join(where, ["path", "statement"]).select("path", "text", "from")
    far = imported.join(own.where(F.col("holder") == FILE).select(F.col("path").alias("from"), "text", "body"), ["from", "text"]).select("path", "text", F.lit(FILE).alias("holder"), F.col("from").alias("in"), "body")
    callable_ = own.select("path", "text", "holder", F.col("path").alias("in"), "body").unionByName(far)

    # Calls that matter, and which of them stands innermost around each thing.
    call = t.where(is_any("called")).join(made.select("path", (F.col("params") - 1).alias("i")), ["path", "i"], "left_anti")
    harm = F.lit(None).cast("string")
    for kind, names in sinks.items():
        harm = F.when(F.col("text").isin(*names), kind).otherwise(harm)
    call = call.select("path", "i", "scope", "text", is_any("member").alias("member"), "line_no", "depth", "target", "end", F.when(F.col("text").isin(*cleaners), "clean").otherwise(harm).alias("harm"))
    reach = call.where("not member").select("path", "i", "scope", "text").join(all_, ["path", "scope"]).join(callable_, ["path", "holder", "text"]).groupBy("path", "i").agg(F.min(F.struct("steps", "in", "body")).alias("to"))
    call = call.join(reach, ["path", "i"], "left").select("path", F.col("i").alias("called"), "line_no", "depth", "target", "end", "to.in", "to.body", F.when(F.col("to").isNull(), F.col("harm")).alias("harm"))
    call = kept(call.where("body is not null or harm is not null"))

    # What a statement's value goes to.
    named = kept(t.where(is_any("used", "sets")).select("path", "i", "depth", "scope", "text", "flags", "aims", "target").join(meant, ["path", "scope", "text"], "left").withColumn("holder", F.coalesce("holder", F.lit(FILE))))
    sets = named.where(F.col("aims") & is_any("sets")).select("path", F.col("i").alias("target"), _node(F.col("holder").cast("string"), F.col("text")).alias("dst"), F.when(F.col("holder") == F.col("scope"), "within").otherwise("out").alias("kind"))
    returns = t.where(F.col("aims") & ~is_any("sets")).select("path", F.col("i").alias("target"), _node(F.col("scope").cast("string"), "->").alias("dst"), F.lit("within").alias("kind"))
    targets = sets.unionByName(returns)

    # The things of a statement: variables, sources, results of calls. With them the commas, which number the arguments: those of the call's own depth before a thing.
    result = lambda i: _node(i.cast("string"), "()")
    from_source = t.where(is_any("source")).select("path", "i", "depth", "target", _node(F.col("line_no").cast("string"), "?").alias("thing"))
    variables = named.where(is_any("used")).select("path", "i", "depth", "target", _node(F.col("holder").cast("string"), F.col("text")).alias("thing"))
    known = call.where("body is not null")
    results = known.select("path", F.col("called").alias("i"), "depth", "target", result(F.col("called")).alias("thing"))
    up = known.select(F.lit("up").alias("kind"), _node(F.col("in"), F.col("body").cast("string"), "->").alias("src"), _node(F.col("path"), result(F.col("called"))).alias("dst"), F.lit(None).cast("string").alias("call"))
    marks = t.where(is_any("comma")).select("path", "i", "depth", "target", F.lit(None).cast("string").alias("thing"))
    things = from_source.unionByName(variables).unionByName(results).unionByName(marks)
    things = innermost(things, call.select("path", (F.col("called") + 1).alias("first"), F.col("end").alias("last"), F.struct("called", (F.col("depth") + 1).alias("own"), "in", "body", "harm", "line_no").alias("id")))
    place = F.sum((F.col("thing").isNull() & (F.col("depth") == F.col("region.own"))).cast("int")).over(Window.partitionBy("path", "region.called").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    things = kept(things.withColumn("place", place.cast("int")).where("thing is not null and (region is not null or target is not null)").select("path", "thing", "target", "place", "region"))

    none = F.lit(None).cast("string").alias("call")
    places = params.select(F.col("path").alias("in"), F.col("scope").alias("body"), "place", "text")
    thing = _node(F.col("path"), F.col("thing")).alias("src")
    down = things.where("region.body is not null").select(thing, "place", "region.in", "region.body", _node(F.col("path"), result(F.col("region.called"))).alias("call")).join(places, ["in", "body", "place"])
    down = down.select(F.lit("down").alias("kind"), "src", _node(F.col("in"), F.col("body").cast("string"), F.col("text")).alias("dst"), "call")
    harmed = things.where("region.harm <> 'clean'").select(F.lit("within").alias("kind"), thing, _node(F.col("path"), F.col("region.line_no").cast("string"), F.concat(F.lit("!"), F.col("region.harm"))).alias("dst"), none)
    free = things.where("region is null").select("path", "target", "thing").join(targets, ["path", "target"]).select("kind", thing, _node(F.col("path"), F.col("dst")).alias("dst"), none)
    return kept(down.unionByName(harmed).unionByName(free).unionByName(up).where("src <> dst").distinct())


def summaries(spark: SparkSession, graph: DataFrame) -> DataFrame:
    """src, dst: from what a call is given to its result, where the parameter reaches the function's result without leaving the function, by what is known of the functions
    it calls. Pairs of a parameter and what it reaches grow by joins of the new ones, with edges and with summaries found so far."""
    # No parameter leads to a source, and no sink to a result.
    last = lambda c: F.substring_index(c, "|", -1)
    within = graph.where("kind = 'within'").where((last("src") != "?") & ~last("dst").startswith("!")).select("src", "dst")
    down = cut(spark, graph.where("kind = 'down'").select("src", F.col("dst").alias("param"), "call"))
    results = graph.where("kind = 'up'").select(F.col("src").alias("result"), F.col("dst").alias("call"))
    of = cut(spark, down.join(results, "call").select("src", "param", "call", "result"))
    pairs = cut(spark, of.select("param", F.col("param").alias("at")).distinct())
    found = cut(spark, of.select("src", F.col("call").alias("dst")).limit(0))
    front, edges = pairs, within
    while True:
        while not front.isEmpty():
            new = front.join(edges, F.col("at") == F.col("src")).select("param", F.col("dst").alias("at")).distinct()
            front = cut(spark, new.join(pairs, ["param", "at"], "left_anti"))
            pairs = cut(spark, pairs.unionByName(front))
        sums = of.join(pairs.select("param", F.col("at").alias("result")), ["param", "result"], "left_semi").select("src", F.col("call").alias("dst")).distinct()
        fresh = cut(spark, sums.join(found, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return found
        found = cut(spark, found.unionByName(fresh))
        edges = within.unionByName(found)
        # What had been reached goes on over the new edges.
        front = cut(spark, pairs.join(fresh, F.col("at") == F.col("src")).select("param", F.col("dst").alias("at")).distinct().join(pairs, ["param", "at"], "left_anti"))
        pairs = cut(spark, pairs.unionByName(front))


def taint_paths(spark: SparkSession, files: DataFrame, **options) -> DataFrame:
    """path, line_no, kind, source_path, source_line: sinks that input reaches, with the first source by path and line."""
    graph = flow_graph(spark, files, **options)
    cuts = F.split("node", "[|]")
    # Each thing is two: reached from within or below (up), or through a parameter (not up).
    ways = graph.select("src", "dst", "kind").unionByName(summaries(spark, graph).withColumn("kind", F.lit("within")))
    edges = cut(spark, ways)
    start = graph.where("src like '%|?'").select(F.col("src").alias("node")).distinct()
    reached = cut(spark, start.select("node", F.lit(True).alias("up"), F.struct(cuts[0].alias("path"), cuts[1].cast("int").alias("line")).alias("source")))
    front = reached
    # Results go up only from below; into a variable of a scope around is up again, down into a parameter no more.
    to_up = F.when(F.col("kind") == "within", F.col("up")).otherwise(F.col("kind") != "down")
    while not front.isEmpty():
        came = front.join(edges, F.col("node") == F.col("src")).where("kind <> 'up' or up").select(F.col("dst").alias("node"), to_up.alias("up"), "source").groupBy("node", "up").agg(F.min("source").alias("came"))
        merged = cut(spark, reached.join(came, ["node", "up"], "full").select("node", "up", F.least("source", "came").alias("source"), (F.col("source").isNull() | (F.col("came") < F.col("source"))).alias("new")))
        reached = merged.select("node", "up", "source")
        front = merged.where("new").select("node", "up", "source")
    reached = reached.groupBy("node").agg(F.min("source").alias("source"))
    return reached.where("node like '%|!%'").select(cuts[0].alias("path"), cuts[1].cast("int").alias("line_no"), F.substring(cuts[2], 2, 100).alias("kind"), F.col("source.path").alias("source_path"), F.col("source.line").alias("source_line"))
