"""URL filters: allow and block rules on hosts and path prefixes, by a sort-merge range join.

A rule of a host covers the host and its subdomains. With its labels reversed, ``de.example.com`` becomes
``com.example.de.``, and the hosts a rule covers are exactly the keys in the interval [``com.example.``, ``com.example/``),
since ``/`` follows ``.`` and no key holds it. The paths a rule covers are an interval too. Both range joins are the same
sweep: interval ends and keys are sorted together, and between two ends the same rules are open, nested one in another.
Every end carries its stack, the open rules from outermost to innermost, which is worked out on the rules alone; a key
takes the stack of the last end before it.

The sweep runs over range slices of the sorted keys, so a host with a third of all pages covers many slices. Equal
(host, path) pairs are judged once. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from last to first, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _ends(prefixes: DataFrame, after: Column) -> DataFrame:
    """Interval ends of distinct ``prefix`` values: (key, stack), the stack as an array of prefixes, outermost first.

    ``after`` is the least key behind all keys that begin with the prefix.
    """
    one = prefixes.distinct()
    begins = F.explode(F.sequence(F.lit(1), F.length("prefix")))
    outer = one.where("prefix <> ''").select("prefix", begins.alias("size"))
    outer = outer.select("prefix", F.substring("prefix", F.lit(1), F.col("size")).alias("outer"))
    nested = outer.join(one.withColumnRenamed("prefix", "outer"), "outer").groupBy("prefix").agg(
        F.transform(
            F.array_sort(F.collect_set(F.struct(F.length("outer").alias("size"), F.col("outer")))), lambda x: x["outer"]
        ).alias("stack")
    )
    begin = nested.select(F.col("prefix").alias("key"), "stack")
    end = nested.select(after.alias("key"), F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack"))
    return begin.unionByName(end)


def sweep(keys: DataFrame, ends: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of ``keys``, whose sort key is ``key``, each with the stack of the last interval end at or before it.

    ``order`` are columns that tell rows of one key apart, so that slices can part them.
    """
    columns = [c for c in keys.columns if c != "key"]
    blank = [F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in columns]
    marks = ends.select("key", F.col("stack"), F.lit(0).alias("turn"), *blank)
    points = keys.select("key", F.lit(None).cast("array<string>").alias("stack"), F.lit(1).alias("turn"), *columns)
    ordered = marks.unionByName(points).repartitionByRange("key", "turn", *order)
    # Written once: every later read and every retry sees the same slices.
    slices = cut(ordered.withColumn("slice", F.spark_partition_id()), "slices")
    last = slices.where("turn = 0").groupBy("slice").agg(F.max_by("stack", "key").alias("own"))
    numbers = slices.groupBy("slice").agg(F.count("*").alias("rows")).join(last, "slice", "left")
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = numbers.select("slice", F.last("own", ignorenulls=True).over(earlier).alias("carried"))
    so_far = Window.partitionBy("slice").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    inside = slices.withColumn("inside", F.last("stack", ignorenulls=True).over(so_far)).where("turn = 1")
    return inside.join(carried, "slice").select("key", F.coalesce("inside", "carried").alias("stack"), *columns)


def parsed_rules(rules: DataFrame) -> DataFrame:
    """Rules of text ``rule`` (host/path) and ``verdict`` with host and path apart; a rule without ``/`` has no path.

    Repeats count once; of one rule with two verdicts, block stands. Rules that are NULL or lack a host are left out.
    """
    host = F.translate(F.regexp_extract("rule", "^[^/]*", 0), UPPER, LOWER)
    path = F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    apart = rules.where("rule is not null and verdict is not null").select(
        F.concat(host, path).alias("rule"), "verdict", host.alias("rule_host"), path.alias("rule_path")
    )
    return apart.where("rule_host <> ''").groupBy("rule", "rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """All rows and columns of ``pages`` with host, path, rule and verdict (in a struct ``judged``).

    A rule fits urls of its host and all subdomains whose path starts with the rule's; the longest rule wins, of equally
    long ones the one of the longer host. Without a rule, ``rule`` is NULL and ``verdict`` the default. A NULL url, or one
    without ``://``, has empty host and path. Repeated pages are judged alike; an empty rule table judges all by default.
    """
    known = cut(parsed_rules(rules), "rules")
    # Spark's own name resolution must not mix up the judgement with columns of the pages.
    located = pages.select(F.struct(*pages.columns).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    pairs = located.select("host", "path").distinct().withColumn("key", host_key(F.col("host")))
    hosts = known.select(host_key(F.col("rule_host")).alias("prefix"))
    behind = F.concat(F.expr("substring(prefix, 1, length(prefix) - 1)"), F.lit("/"))
    covered = sweep(pairs, _ends(hosts, behind), ["path"]).where("stack is not null")
    # Paths as hex digits: the keys that begin with a prefix end before the prefix with a letter behind F.
    open_hosts = covered.select("host", "path", F.explode("stack").alias("rule_key")).select(
        "host", "path", "rule_key", F.concat("rule_key", F.lit("/"), F.hex(F.col("path").cast("binary"))).alias("key")
    )
    rule_prefix = F.concat(host_key(F.col("rule_host")), F.lit("/"), F.hex(F.col("rule_path").cast("binary")))
    named = known.select(rule_prefix.alias("prefix"), "rule", "rule_host", "verdict")
    ends = _ends(named.select("prefix"), F.concat("prefix", F.lit("G")))
    inner = sweep(open_hosts, ends, ["host"]).where("size(stack) > 0").select(
        "host", "path", F.try_element_at("stack", F.lit(-1)).alias("prefix")
    )
    rank = F.struct(F.length("rule"), F.length("rule_host"), F.col("rule"))
    best = (
        inner.join(named, "prefix")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    )
    judged = located.join(best, ["host", "path"], "left")
    return judged.select(
        "page",
        F.struct(
            "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
        ).alias("judged"),
    )
