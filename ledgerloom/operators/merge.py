"""Keyed merges of a change set into a base table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(left: str, right: str, keys: Sequence[str], place: str | None = None) -> Column:
    """Equal keys, in which NULL is a value like others.

    ``place`` names a column of both sides that is never NULL and follows from the keys: sides that lie by it are joined
    where they are.
    """
    equal = [F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}")) for key in keys]
    return reduce(and_, equal if place is None else [F.col(f"{left}.{place}") == F.col(f"{right}.{place}"), *equal])


def _without(base: DataFrame, gone: DataFrame, keys: Sequence[str], place: str | None = None) -> DataFrame:
    """Rows of ``base`` whose key is not in ``gone``."""
    named = [*keys] if place is None else [place, *keys]
    return base.alias("b").join(gone.select(*named).distinct().alias("d"), _same("b", "d", keys, place), "left_anti")


def upsert(
    base: DataFrame,
    delta: DataFrame,
    keys: Sequence[str],
    defaults: Mapping[str, Column] | None = None,
    place: str | None = None,
) -> DataFrame:
    """Insert new keys and overwrite, in existing ones, only the columns ``delta`` supplies.

    Keys are unique on both sides, so one co-partitioned outer join is enough and no key can
    be skewed. A NULL key equals a NULL key. Columns a new row does not supply take their default.
    """
    defaults = dict(defaults or {})
    mark = delta.select(*delta.columns, F.lit(True).alias("_new")).alias("d")
    old = base.select(*base.columns, F.lit(True).alias("_old")).alias("b")
    columns = []
    for name in base.columns:
        if name in keys or name == place:
            value = F.when(F.col("d._new"), F.col(f"d.{name}")).otherwise(F.col(f"b.{name}"))
        elif name in delta.columns:
            value = F.when(F.col("d._new"), F.col(f"d.{name}")).otherwise(F.col(f"b.{name}"))
        else:
            value = F.when(F.col("b._old"), F.col(f"b.{name}")).otherwise(defaults.get(name, F.lit(None)))
        columns.append(value.cast(base.schema[name].dataType).alias(name))
    return old.join(mark, _same("b", "d", keys, place), "full_outer").select(*columns)


def patch(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overwrite columns of existing rows where ``delta`` holds a value; NULL keeps the current one."""
    changes = delta.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in delta.columns if c not in keys])
    joined = base.join(changes, list(keys), "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if f"_new_{c}" in changes.columns else F.col(c)
            for c in base.columns
        ]
    )


def insert_missing(base: DataFrame, delta: DataFrame, keys: Sequence[str], place: str | None = None) -> DataFrame:
    """Append the rows of ``delta`` whose key the base does not hold."""
    return base.unionByName(_without(delta, base, keys, place))


def replace_slice(
    base: DataFrame, delta: DataFrame, keys: Sequence[str], append: bool = True, place: str | None = None
) -> DataFrame:
    """Drop every base row of the keys present in ``delta``, then append ``delta`` unless told not to."""
    kept = _without(base, delta, keys, place)
    return kept.unionByName(delta) if append else kept


def with_default(df: DataFrame, right: DataFrame, keys: Sequence[str], defaults: Mapping[str, Column]) -> DataFrame:
    """Left join that shows a default row where the right side has none."""
    joined = df.join(right, list(keys), "left")
    return joined.select(
        *[F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in joined.columns]
    )


def findings(required: DataFrame, present: DataFrame, keys: Sequence[str], severity: str) -> DataFrame:
    """Rows of ``required`` that ``present`` lacks, marked with a severity."""
    return required.join(present.select(*keys).distinct(), list(keys), "left_anti").withColumn(
        "severity", F.lit(severity)
    )
