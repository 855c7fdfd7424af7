"""Graph operators in few rounds, against plain Python on random graphs and on long chains."""

import random

import pytest
from lodestone.operators import graph


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def brute_strong(edges):
    near, back = {}, {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)

    def reach(start, ways):
        seen, todo = {start}, [start]
        while todo:
            for x in ways.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    out = {}
    for v in {x for e in edges for x in e}:
        c = reach(v, near) & reach(v, back)
        if len(c) > 1:
            out[v] = max(c)
    return out


def brute_depths(edges, entries):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    out = {}
    for e in set(entries):
        dist, todo = {e: 0}, [e]
        for v in todo:
            for x in near.get(v, ()):
                if x not in dist:
                    dist[x] = dist[v] + 1
                    todo.append(x)
        for v, d in dist.items():
            if d:
                out[v] = max(out.get(v, 0), d)
    return out


@pytest.mark.parametrize("seed, n, m", [(1, 12, 14), (2, 40, 44), (3, 40, 60), (4, 60, 62), (5, 25, 90), (6, 8, 8)])
def test_strong_components(spark, seed, n, m):
    draw = random.Random(seed)
    edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (200, 200), (300, 301), (301, 300), (5, 300)]
    assert {r.node: r.component for r in graph.strong_components(spark, frame(spark, edges)).collect()} == brute_strong(edges)


def test_long_chains_take_few_rounds(spark):
    from pyspark.sql import functions as F

    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    rounds = []
    assert graph.strong_components(spark, chain, rounds).isEmpty() and len(rounds) < 60
    ring = chain.select(((F.col("src") * 7919) % n).alias("src"), ((F.col("dst") * 7919) % n).alias("dst"))
    rounds = []
    found = graph.strong_components(spark, ring, rounds)
    assert found.groupBy("component").count().collect() == [(n - 1, n)] and len(rounds) < 60


def test_no_edges(spark):
    none = frame(spark, [(1, 1)]).where("src > 5")
    assert graph.strong_components(spark, none).count() == 0
    assert graph.depths(spark, none, none.select("src").toDF("node")).count() == 0


@pytest.mark.parametrize("seed, n, m, k", [(1, 30, 40, 3), (2, 300, 500, 200), (3, 50, 400, 50)])
def test_depths(spark, seed, n, m, k):
    draw = random.Random(seed)
    edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]
    entries = [draw.randrange(n + 5) for _ in range(k)]
    got = graph.depths(spark, frame(spark, edges), spark.createDataFrame([(e,) for e in entries], "node long").repartition(3))
    assert {r.node: r.depth for r in got.collect()} == brute_depths(edges, entries)


def brute_blocks(edges):
    """Biconnected parts by walking depth first, as sets of nodes."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seen, low, stack, out = {}, {}, [], []

    def walk(v, parent):
        seen[v] = low[v] = len(seen)
        for x in near[v]:
            if x == parent:
                continue
            if x in seen:
                if seen[x] < seen[v]:
                    stack.append((v, x))
                low[v] = min(low[v], seen[x])
                continue
            at = len(stack)
            stack.append((v, x))
            walk(x, v)
            low[v] = min(low[v], low[x])
            if low[x] >= seen[v]:
                out.append(frozenset(n for e in stack[at:] for n in e))
                del stack[at:]

    for v in sorted(near):
        if v not in seen:
            walk(v, None)
    return out


@pytest.mark.parametrize("seed, n, m", [(1, 10, 11), (2, 30, 34), (3, 40, 44), (4, 25, 60), (5, 60, 62)])
def test_blocks_and_connectors(spark, seed, n, m):
    draw = random.Random(seed)
    edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(70, 70)] + [(80 + k, 81 + k) for k in range(6)] + [(100, 101 + k) for k in range(5)] + [(k, k + 3) for k in range(200, 212)]
    want = brute_blocks(edges)
    got = {}
    for r in graph.blocks(spark, frame(spark, edges)).collect():
        got.setdefault(r.block, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    several = {v for b in want for v in b if sum(v in c for c in want) > 1}
    assert {r.node for r in graph.connectors(spark, frame(spark, edges)).collect()} == several


def test_connectors_of_named_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert sorted(r.node for r in graph.connectors(spark, edges).collect()) == ["c", "d"]
    assert graph.connectors(spark, edges.where("src > 'z'")).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
@pytest.mark.parametrize("seed, n, m", [(1, 12, 16), (3, 60, 64)])
def test_connectors_by_layers(spark, monkeypatch, seed, n, m, few):
    monkeypatch.setattr(graph, "FEW", few)
    draw = random.Random(seed)
    pairs = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(90, 90), (91, 90), (92, 92), (93, 94), (93, 95)]
    pairs += [(None, 3), (3, None), pairs[0]]
    whole = [e for e in pairs if None not in e]

    def several(edges):
        parts = brute_blocks(edges)
        return {v for b in parts for v in b if sum(v in c for c in parts) > 1}

    def refuse(*_):
        raise AssertionError("biconnected parts were looked for")

    monkeypatch.setattr(graph, "blocks", refuse)
    sides = [(a * 2, b * 2 + 1) for a, b in whole]
    assert {r.node for r in graph.connectors(spark, frame(spark, sides), apart=True).collect()} == several(sides)
    if m < 64:
        assert {r.node for r in graph.connectors(spark, frame(spark, pairs)).collect()} == several(whole)


def test_far_connectors_go_by_parts(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_LAYERS", 3)
    chain = [(k, k + 1) for k in range(12)]
    parts = spark.createDataFrame([(x, k) for k in range(12) for x in (k, k + 1)], "node long, block long")
    monkeypatch.setattr(graph, "blocks", lambda *_: parts)
    assert {r.node for r in graph.connectors(spark, frame(spark, chain)).collect()} == set(range(1, 12))
