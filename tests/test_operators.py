import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.columns import newest, oldest
from ledgerloom.operators import graph, lookup, merge, rows
from ledgerloom.session import cut


def hot_rows(n=3000, groups=40, seed=7):
    """Rows of which about a third belong to one group."""
    rng = random.Random(seed)
    order = list(range(n))
    rng.shuffle(order)
    return [("hot" if rng.random() < 0.34 else f"g{rng.randrange(groups)}", at, f"v{rng.randrange(3)}") for at in order]


def test_best_by_limits_rows_before_the_shuffle(spark):
    data = hot_rows()
    df = spark.createDataFrame(data, "g string, at int, v string")
    best = rows.best_by(df, ["g"], [newest("v"), oldest("at")])
    want = {}
    for g, at, v in sorted(data, key=lambda r: r[1]):
        if g not in want or v > want[g][1]:
            want[g] = (at, v)
    assert {r["g"]: (r["at"], r["v"]) for r in best.collect()} == want
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_null_sorts_as_the_largest_value(spark):
    df = spark.createDataFrame([("a", 1), ("a", None)], "g string, v int")
    assert rows.best_by(df, ["g"], [newest("v")]).first()["v"] is None
    assert rows.best_by(df, ["g"], [oldest("v")]).first()["v"] == 1


def test_numbers_are_consecutive_in_a_hot_group(spark):
    data = hot_rows()
    df = spark.createDataFrame(data, "g string, at int, v string")
    got = rows.numbered(df, ["g"], [F.col("at").asc()], "n").collect()
    seen = {}
    for g, at, _ in sorted(data, key=lambda r: r[1]):
        seen.setdefault(g, []).append(at)
    want = {(g, at): n for g, ats in seen.items() for n, at in enumerate(ats, start=1)}
    assert {(r["g"], r["at"]): r["n"] for r in got} == want


def test_previous_crosses_slices(spark):
    data = hot_rows()
    df = spark.createDataFrame(data, "g string, at int, v string")
    got = {(r["g"], r["at"]): r["p"] for r in rows.previous(df, ["g"], "at", "v", "p").collect()}
    last, want = {}, {}
    for g, at, v in sorted(data, key=lambda r: r[1]):
        want[g, at] = last.get(g)
        last[g] = v
    assert got == want


def test_argmin_concat_ignores_rows_with_a_missing_part(spark):
    df = spark.createDataFrame([("k", "a", None), ("k", "b", 2), (None, "a", 1)], "k string, a string, b int")
    assert [tuple(r) for r in rows.argmin_concat(df, "k", "a", "b").collect()] == [("k", "b", 2)]


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("g", 1, "c"), ("g", 2, "c")], "g string, at int, v string")
    got = {(r["g"], r["at"]): r["n"] for r in rows.numbered(df, ["g"], [F.col("at").asc()], "n").collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("g", 1): 1, ("g", 2): 2}
    before = {(r["g"], r["at"]): r["p"] for r in rows.previous(df, ["g"], "at", "v", "p").collect()}
    assert before == {(None, 1): None, (None, 2): "a", ("g", 1): None, ("g", 2): "c"}


def test_upsert_changes_only_supplied_columns(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, note string")
    delta = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    got = merge.upsert(base, delta, ["k"], {"note": F.lit("nuevo")})
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", "x"), (2, None, "y"), (3, "c", "nuevo")]


def test_patch_insert_and_replace(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, None), (3, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in merge.patch(base, delta.limit(1), ["k"]).collect()) == [(1, "a"), (2, "b")]
    inserted = merge.insert_missing(base, delta, ["k"])
    assert sorted((r["k"], r["v"]) for r in inserted.collect()) == [(1, "a"), (2, "b"), (3, "c"), (3, "d")]
    replaced = merge.replace_slice(base, delta.where("k = 3 OR k = 2").na.fill("z"), ["k"])
    assert sorted(tuple(r) for r in replaced.collect()) == [(1, "a"), (2, "z"), (3, "c"), (3, "d")]


def test_walk_upstream_ends_on_cycles(spark):
    edges = spark.createDataFrame(
        [("r", "b", "a"), ("r", "c", "b"), ("r", "a", "c"), ("r", "d", "a"), ("s", "z", "a")],
        "run_id string, source_node string, target_node string",
    )
    seeds = spark.createDataFrame([("r", "a")], "run_id string, node string")
    got = {(r["node"], r["depth"]) for r in graph.upstream(seeds, edges, ["run_id"]).collect()}
    assert got == {("b", 1), ("d", 1), ("c", 2), ("a", 3)}


def test_levels_take_the_longest_chain(spark):
    nodes = spark.createDataFrame([("r", n) for n in "abcd"], "run_id string, node string")
    needs = spark.createDataFrame(
        [("r", "b", "a"), ("r", "c", "b"), ("r", "c", "a"), ("r", "d", "fuera")],
        "run_id string, node string, needed string",
    )
    got = {r["node"]: r["level"] for r in graph.levels(nodes, needs, ["run_id"]).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 0}
    loop = needs.unionByName(spark.createDataFrame([("r", "a", "c")], needs.schema))
    got = {r["node"]: r["level"] for r in graph.levels(nodes, loop, ["run_id"]).collect()}
    assert got == {"a": 0, "b": 0, "c": 0, "d": 0}


def test_walks_have_no_depth_limit(spark):
    chain = [("r", f"n{i + 1}", f"n{i}") for i in range(70)]
    edges = spark.createDataFrame(chain, "run_id string, source_node string, target_node string").coalesce(1)
    seeds = spark.createDataFrame([("r", "n0")], "run_id string, node string")
    got = {r["node"]: r["depth"] for r in graph.upstream(seeds, edges, ["run_id"]).collect()}
    assert got == {f"n{i}": i for i in range(1, 71)}


def test_walks_take_logarithmic_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or cut(df, name))
    edges = spark.range(1000).selectExpr("'r' as run_id", "id + 1 as source_node", "id as target_node")
    seeds = spark.createDataFrame([("r", 0)], "run_id string, node long")
    reached = graph.upstream(seeds, edges, ["run_id"])
    assert reached.agg(F.count("*"), F.max("depth"), F.sum(F.abs(F.col("depth") - F.col("node")))).first()[:] == (1000, 1000, 0)
    assert sum(name.startswith("reached") for name in written) <= 12
    written.clear()
    nodes = spark.range(1001).selectExpr("'r' as run_id", "id as node")
    needs = edges.selectExpr("run_id", "source_node as node", "target_node as needed")
    found = graph.levels(nodes, needs, ["run_id"])
    assert found.agg(F.count("*"), F.max("level"), F.sum(F.abs(F.col("level") - F.col("node")))).first()[:] == (1001, 1000, 0)
    assert written.count("heights") <= 11


def _plain_walks(nodes, edges):
    """Least distances (1 or more) from every node along edges, by breadth."""
    out = {}
    for start in nodes:
        seen, front, depth = {}, {start}, 0
        while front:
            depth += 1
            front = {v for u, v in edges if u in front} - set(seen)
            seen |= {v: depth for v in front}
        out[start] = seen
    return out


def _plain_levels(nodes, edges):
    reach = _plain_walks(nodes, edges)
    ring = {n: min(m for m in reach[n] if n in reach[m]) if n in reach[n] else None for n in nodes}
    one = {n: ring[n] or n for n in nodes}
    below = {(one[u], one[v]) for u, v in edges if one[u] != one[v]}

    def height(n):
        return max((1 + height(v) for u, v in below if u == n), default=0)

    return {n: (height(one[n]), ring[n]) for n in nodes}


@pytest.mark.parametrize("growth", [0, 8])
def test_walks_and_levels_on_any_graph(spark, monkeypatch, growth):
    """Sparse and dense random graphs with circles, circles in chains, self needs; with and without longer steps."""
    monkeypatch.setattr(graph, "GROWTH", growth)
    rng, scopes = random.Random(growth), {}
    for number in range(8):
        size = rng.randrange(3, 14)
        nodes = [f"n{i:02}" for i in range(size)]
        edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.randrange(size * 2))}
        scopes[f"s{number}"] = nodes, edges
    chain = [f"n{i:02}" for i in range(16)]
    scopes["rings"] = chain, set(zip(chain, chain[1:])) | {("n05", "n03"), ("n12", "n12"), ("n14", "n13")}
    scopes["free"] = ["n1"], set()
    nodes = spark.createDataFrame([(s, n) for s, (ns, _) in scopes.items() for n in ns], "run_id string, node string")
    rows = [(s, u, v) for s, (_, es) in scopes.items() for u, v in es] + [("free", "n1", "outside")]
    needs = spark.createDataFrame(rows, "run_id string, node string, needed string")
    got = {(r.run_id, r.node): (r.level, r.component) for r in graph.levels(nodes, needs, ["run_id"]).collect()}
    assert got == {(s, n): found for s, (ns, es) in scopes.items() for n, found in _plain_levels(ns, es).items()}

    seeds = spark.createDataFrame([(s, ns[0]) for s, (ns, _) in scopes.items()], "run_id string, node string")
    edges = needs.selectExpr("run_id", "needed as source_node", "node as target_node").where("run_id <> 'free'")
    reached = {(r.run_id, r.node): r.depth for r in graph.upstream(seeds, edges, ["run_id"]).collect()}
    want = {s: _plain_walks([ns[0]], es)[ns[0]] for s, (ns, es) in scopes.items()}
    assert reached == {(s, n): depth for s, found in want.items() for n, depth in found.items()}


def test_one_join_looks_up_several_columns(spark, monkeypatch):
    rng = random.Random(5)
    pick = lambda: rng.choice([None, "b0", "b0", *[f"b{i}" for i in range(12)]])
    data = [(i // 2, pick(), pick(), pick(), f"x{i % 3}") for i in range(300)]
    df = spark.createDataFrame(data, "id int, one string, two string, three string, x string")
    dimension = spark.createDataFrame([(f"b{i}", f"B{i}") for i in range(8)] + [(None, "none")], "k string, v string")
    named = {f"b{i}": f"B{i}" for i in range(8)}
    want = sorted(((*row, *[named.get(row[n]) for n in (1, 2, 3)]) for row in data), key=str)
    columns = ["one", "two", "three"]
    small = lookup.looked_up(df, columns, dimension, "k", "v")
    assert sorted((tuple(r) for r in small.collect()), key=str) == want
    monkeypatch.setattr(lookup, "SMALL", 0)
    large = lookup.looked_up(df, columns, dimension, "k", "v")
    assert sorted((tuple(r) for r in large.select(small.columns).collect()), key=str) == want
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and plan.count("Join LeftOuter") == 1


def test_nodes_of_levels_are_found_once(spark, monkeypatch):
    """Repeated nodes are made distinct in one written table; what reads the nodes later reads that."""
    from ledgerloom.operators import graph

    written, cut = {}, graph.cut

    def kept(df, name):
        made = cut(df, name)
        written.setdefault(name, made)
        return made

    monkeypatch.setattr(graph, "cut", kept)
    nodes = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "b"), ("r", "c"), (None, "d")], "run_id string, node string")
    needs = spark.createDataFrame([("r", "b", "a"), ("r", "b", "a"), ("r", "c", "b"), ("r", "c", "x")], "run_id string, node string, needed string")
    got = graph.levels(nodes, needs, ["run_id"])
    assert sorted(map(tuple, written["nodes"].collect()), key=str) == [("r", "a"), ("r", "b"), ("r", "c"), (None, "d")]
    assert {tuple(row)[:3] for row in got.where("run_id is not null").collect()} == {("r", "a", 0), ("r", "b", 1), ("r", "c", 2)}
