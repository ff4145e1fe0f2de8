"""Decoding of protected columns, once for each stored value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import Decoder
from ledgerloom.session import cut


def decode_dictionary(rows: DataFrame, table: str, columns: Sequence[str], decoder: Decoder, on_error: str) -> DataFrame:
    """Every distinct stored value of the columns with its clear text: (field, stored, clear), a written table.

    The columns are unpivoted, so one aggregate finds the distinct values of all of them, and each is decoded in the one
    branch of its column. Because the table is written, no later filter or projection decodes again.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("stored")) for name in columns])
    values = rows.select(F.explode(pairs).alias("p")).select("p.*").where("stored is not null").distinct()
    values = cut(values, "stored_values")

    def decoded(other: Column, name: str) -> Column:
        return F.when(F.col("field") == name, decoder(F.col("stored"), table, name, on_error)).otherwise(other)

    clear = reduce(decoded, columns, F.lit(None).cast("string"))
    return cut(values.withColumn("clear", clear), "decode_dictionary")


def with_decoded(rows: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with ``clear_<column>`` for each protected column, looked up in the dictionary; NULL stays NULL.

    A frequent stored value is a hot key of the rows only, on the left of the join, where it is split.
    """
    for name in columns:
        known = dictionary.where(F.col("field") == name).select(
            F.col("stored").alias(f"_stored_{name}"), F.col("clear").alias(f"clear_{name}")
        )
        rows = rows.join(known, rows[name].cast("string") == F.col(f"_stored_{name}"), "left").drop(f"_stored_{name}")
    return rows
