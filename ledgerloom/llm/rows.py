"""Naming and fetching rows of a table of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most keys that are broadcast to pick rows, 16 bytes each before Spark's own overhead.
BROADCAST_KEYS = 1_000_000


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with ``row_hash``, which with doc_id names a row up to equal rows."""
    return docs.withColumn("row_hash", F.xxhash64("text"))


def fetched(docs: DataFrame, wanted: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The documents whose keys are in ``wanted``, a table of at most ``most`` rows.

    Few keys are broadcast, so that texts nobody asked for stay where they are; more keys meet the texts in a shuffle.
    """
    picked = wanted.select(*keys).distinct()
    return docs.join(F.broadcast(picked) if most <= BROADCAST_KEYS else picked, keys, "left_semi")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose doc_id and text are not among the rows (doc_id, row_hash) ``gone``, a written table.

    Few rows are broadcast, as in :func:`fetched`. Columns of the documents may have any names.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"), "text")
    named = gone.select(F.col("doc_id").alias("_doc"), F.col("row_hash").alias("_hash"))
    named = F.broadcast(named) if gone.count() <= BROADCAST_KEYS else named
    same = rows["_doc"].eqNullSafe(named["_doc"]) & (F.xxhash64(rows["text"]) == named["_hash"])
    return rows.join(named, same, "left_anti").select("row.*")


def without_rows(docs: DataFrame, row_id: Column, gone: DataFrame) -> DataFrame:
    """The documents whose ``row_id``, an expression on their columns, is not in the written table ``gone`` of row ids."""
    rows = docs.select(F.struct("*").alias("row"), row_id.alias("row_id"))
    named = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return rows.join(named, "row_id", "left_anti").select("row.*")
