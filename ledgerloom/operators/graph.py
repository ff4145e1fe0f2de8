"""Walks over large edge tables in rounds that grow with the logarithm of the depth.

A round joins what is known with steps of length s, not 1: pairs of nodes that a walk of exactly s edges connects. Steps
are doubled after each round by joining them with themselves, as long as that makes at most ``GROWTH`` times as many pairs
as there are edges, which is counted before the join; a graph in which walks meet too often goes on with the steps it has,
and so takes depth / s rounds. Every round is a table in the shared folder, which keeps plans short and survives the loss
of executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

#: Pairs that doubled steps may have for each edge.
GROWTH = 8


def _steps(edges: DataFrame, scope: Sequence[str]) -> Iterator[tuple[int, DataFrame]]:
    """Lengths and tables (scope, u, v) of steps: first the edges, then twice as long each time while that is cheap."""
    steps, length = cut(edges.select(*scope, "u", "v").distinct(), "steps_1"), 1
    most, doubling = GROWTH * steps.count(), True
    while True:
        yield length, steps
        if doubling:
            into = steps.groupBy(*scope, F.col("v").alias("m")).agg(F.count("*").alias("into"))
            out_of = steps.groupBy(*scope, F.col("u").alias("m")).agg(F.count("*").alias("out"))
            size = into.join(out_of, [*scope, "m"]).agg(F.sum(F.col("into") * F.col("out"))).first()[0]
            doubling = (size or 0) <= most
        if doubling:
            first, second = steps.withColumnRenamed("v", "m"), steps.withColumnRenamed("u", "m")
            length *= 2
            steps = cut(first.join(second, [*scope, "m"]).select(*scope, "u", "v").distinct(), f"steps_{length}")


def upstream(seeds: DataFrame, edges: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Every node that reaches a seed against the edge direction, with its least distance (1 or more).

    ``seeds`` has the scope columns and ``node``; ``edges`` the scope columns, ``source_node`` and ``target_node``. A seed
    is among the nodes if a cycle leads back to it. Any node at a distance from d to d + s has a node s before it on a
    shortest path, so one round with steps of length s finds all of them from the last s distances known; a round that
    finds none is the last, also on cycles.
    """
    key = [*scope, "node"]
    turned = edges.select(*scope, F.col("target_node").alias("u"), F.col("source_node").alias("v"))
    seen = front = None
    known = 1
    for length, steps in _steps(turned, scope):
        if seen is None:
            met = seeds.select(*key).distinct().withColumnRenamed("node", "u").join(steps, [*scope, "u"])
            found = met.select(*scope, F.col("v").alias("node"), F.lit(1).alias("depth")).distinct()
            seen = front = cut(found, "reached_1")
            if front.isEmpty():
                return seen
        last = seen.where(F.col("depth") > known - length).withColumnRenamed("node", "u")
        found = (
            last.join(steps, [*scope, "u"])
            .groupBy(*scope, F.col("v").alias("node"))
            .agg(F.min(F.col("depth") + length).alias("depth"))
            .join(seen.select(*key), key, "left_anti")
        )
        front = cut(found, f"reached_{known + length}")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        known += length


def _heights(nodes: DataFrame, needs: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The longest chain of needs below each node (scope, node, level), and the nodes for which there is none.

    Nodes are distinct; ``needs`` (scope, u, v) lie within them. A node with a walk of length s is s above the highest node that such a
    walk ends in; when those below a level are known, so are the next s levels: nodes all of whose steps end in known ones.
    Nodes that reach a cycle never get that far.
    """
    key = [*scope, "node"]
    waiting = needs.select(*scope, F.col("u").alias("node")).distinct()
    marked = cut(nodes.select(*key).join(waiting.withColumn("_waits", F.lit(True)), key, "left"), "marked")
    done = marked.where("_waits is null").select(*key, F.lit(0).alias("level"))
    left = marked.where("_waits").select(*key)
    if left.isEmpty() or done.isEmpty():
        return done, left
    for length, steps in _steps(needs, scope):
        known = done.select(*scope, F.col("node").alias("v"), "level")
        ends = steps.join(left.withColumnRenamed("node", "u"), [*scope, "u"], "left_semi").join(known, [*scope, "v"], "left")
        highest = ends.groupBy(*scope, F.col("u").alias("node")).agg(
            F.count_if(F.col("level").isNull()).alias("_open"), (F.max("level") + length).alias("level")
        )
        found = cut(highest.where("_open = 0").drop("_open"), "heights")
        if found.isEmpty():
            return done, left
        done = done.unionByName(found)
        left = cut(left.join(found, key, "left_anti"), "waiting")
        if left.isEmpty():
            return done, left


def cycles(nodes: DataFrame, edges: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Nodes on cycles (scope, node) with ``component``, the least node of their strongly connected component.

    What a cycle does not reach, or does not lead to one, is peeled off from both ends. Of the rest, each part in turn takes
    one of its nodes: those it reaches and is reached from are its component; the others fall into parts by which of the
    two hold, as no component spreads over two of them. The node is taken by a hash, so that parts shrink evenly.
    """
    key, part = [*scope, "node"], [*scope, "_part"]
    edges = edges.select(*scope, "u", "v").distinct()
    for flip in (False, True):
        turned = edges.select(*scope, F.col("v").alias("u"), F.col("u").alias("v")) if flip else edges
        nodes = cut(_heights(nodes, turned, scope)[1], "on_cycles")
        if nodes.isEmpty():
            return nodes.withColumn("component", F.col("node"))
        for end in ("u", "v"):
            edges = edges.join(nodes.withColumnRenamed("node", end), [*scope, end], "left_semi")
        edges = cut(edges, "within")
    left, found = cut(nodes.withColumn("_part", F.lit("")), "parts"), None
    while not left.isEmpty():
        inner = edges
        for end in ("u", "v"):
            ends = left.withColumnRenamed("node", end).withColumnRenamed("_part", f"_{end}")
            inner = inner.join(ends, [*scope, end])
        inner = cut(inner.where("_u = _v").withColumnRenamed("_u", "_part").drop("_v"), "inner")
        taken = cut(left.groupBy(*part).agg(F.min_by("node", F.struct(F.xxhash64("node"), "node")).alias("node")), "taken")
        there = upstream(taken, inner.select(*part, F.col("v").alias("source_node"), F.col("u").alias("target_node")), part)
        back = upstream(taken, inner.select(*part, F.col("u").alias("source_node"), F.col("v").alias("target_node")), part)
        sides = (
            left.join(taken.withColumnRenamed("node", "_taken"), part)
            .join(there.select(*part, "node", F.lit("f").alias("_there")), [*part, "node"], "left")
            .join(back.select(*part, "node", F.lit("b").alias("_back")), [*part, "node"], "left")
        )
        sides = cut(sides.na.fill("", ["_there", "_back"]), "sides")
        same = sides.where("(_there = 'f' and _back = 'b') or node = _taken")
        # A taken node that does not come back to itself is on no cycle: it only lies between two.
        on_cycle = cut(same.where("_there = 'f'").select(*key, F.concat_ws("|", "_part", "_taken").alias("_group")), "component")
        found = on_cycle if found is None else found.unionByName(on_cycle)
        rest = sides.where("not (_there = 'f' and _back = 'b') and node <> _taken")
        left = cut(rest.select(*key, F.concat("_part", F.lit("/"), "_there", "_back").alias("_part")), "parts")
    least = found.groupBy(*scope, "_group").agg(F.min("node").alias("component"))
    return found.join(least, [*scope, "_group"]).select(*key, "component")


def levels(nodes: DataFrame, needs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Longest chain of needs below each node, 0 for nodes that need nothing, and the cycle a node is on.

    ``nodes`` has the scope columns and ``node``; ``needs`` the scope columns, ``node`` and ``needed``. Nodes that need each
    other in a circle count as one: they share a level, and ``component`` names the least of them (NULL for other nodes), so
    that what is behind a cycle has a level too. Needs outside the nodes do not count.
    """
    key = [*scope, "node"]
    # Joined four times below, so found once.
    left = cut(nodes.select(*key).distinct(), "nodes")
    links = needs.select(*scope, F.col("node").alias("u"), F.col("needed").alias("v"))
    for end in ("u", "v"):
        links = links.join(left.withColumnRenamed("node", end), [*scope, end], "left_semi")
    links = cut(links.distinct(), "needs")
    done, rest = _heights(left, links, scope)
    if rest.isEmpty():
        return done.withColumn("component", F.lit(None).cast(left.schema["node"].dataType))
    rings = cut(cycles(rest, links.join(rest.withColumnRenamed("node", "u"), [*scope, "u"], "left_semi"), scope), "rings")
    named = cut(left.join(rings, key, "left").withColumn("_one", F.coalesce("component", "node")), "condensed")
    ends = named.select(*key, "_one")
    between = links
    for end in ("u", "v"):
        between = between.join(ends.toDF(*scope, end, f"_{end}"), [*scope, end])
    between = between.where("_u <> _v").select(*scope, F.col("_u").alias("u"), F.col("_v").alias("v"))
    ones = named.select(*scope, F.col("_one").alias("node")).distinct()
    heights = _heights(ones, between, scope)[0].withColumnRenamed("node", "_one")
    return named.join(heights, [*scope, "_one"]).select(*key, "level", "component")
