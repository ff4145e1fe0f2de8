"""Row selection per key: latest, best, first, arg-min, and numbering.

Each keeps one row per key (or bounded slices of a key) before the shuffle, so a key that
holds a large share of the data does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut


def best_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    Spark plans a rank limit on both sides of the shuffle for this shape, so a map task
    sends at most one row per key. ``order`` must end in a unique column.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop later repeats of a key, keeping the first in input order."""
    return best_by(df, keys, [F.col(name).asc_nulls_last() for name in order])


def argmin_concat(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Least ``first|second`` text per key, taken apart again.

    A NULL in either part drops the row from the minimum, unlike a struct comparison.
    """
    text = F.concat(F.col(first).cast("string"), F.lit("|"), F.col(second).cast("string"))
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias("_least"))
    return least.select(
        key,
        F.split_part("_least", F.lit("|"), F.lit(1)).alias(first),
        F.split_part("_least", F.lit("|"), F.lit(2)).try_cast("int").alias(second),
    )


def with_groups(df: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` with the other columns of ``right``, one row per key, in which NULL is a key like others."""
    named = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [df[k].eqNullSafe(named[f"_key_{k}"]) for k in keys]
    return df.join(named, same).drop(*[f"_key_{k}" for k in keys])


def sliced(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows in range slices of (group, order), stored once with their slice number.

    Slices follow the sort order and have similar sizes however rows are spread over groups:
    a huge group covers many slices. The slice number is stored, so every later read and
    every retry sees the same slices.
    """
    ranged = df.repartitionByRange(*[F.col(name) for name in group], *order)
    return cut(ranged.withColumn("_slice", F.spark_partition_id()), "slices")


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Consecutive numbers 1, 2, 3 … within a group, in the order given (unique per group).

    Rows are ranked per slice and shifted by the size of the group's earlier slices.
    """
    rows = sliced(df, group, order)
    sizes = rows.groupBy(*group, "_slice").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*group, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        with_groups(rows.withColumn("_rank", F.row_number().over(inside)), shifts, [*group, "_slice"])
        .withColumn(name, (F.col("_shift") + F.col("_rank")).cast("bigint"))
        .drop("_slice", "_shift", "_rank")
    )


def previous(df: DataFrame, group: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """The value of the preceding row of the same group (``order`` unique, ``value`` never NULL).

    Inside a slice this is ``lag``; the first row of a slice takes the last value of the
    group's nearest earlier slice, found on the much smaller table of slices.
    """
    rows = sliced(df, group, [F.col(order).asc()])
    last = rows.groupBy(*group, "_slice").agg(F.max_by(value, order).alias("_last"))
    earlier = Window.partitionBy(*group).orderBy("_slice")
    carried = last.select(*group, "_slice", F.lag("_last").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*group, "_slice").orderBy(order)
    return (
        with_groups(rows.withColumn("_inside", F.lag(value).over(inside)), carried, [*group, "_slice"])
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_slice", "_inside", "_carried")
    )
