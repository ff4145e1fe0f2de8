"""One dimension looked up by several columns of the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

#: Dimensions of up to so many keys are sent to every task.
SMALL = 1_000_000


def looked_up(rows: DataFrame, columns: Sequence[str], dimension: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with ``_found_<column>`` for each column: the value of the dimension's row of that key, or NULL.

    The dimension has one row per key; the columns are of the key's type. A small dimension, by its counted keys, is
    broadcast and the rows stay where they are. Beyond ``SMALL`` keys the rows are stored with a number each and their
    look-up keys unpivoted to narrow rows (number, which column, key): one join with the dimension serves all columns, one
    aggregate folds its results back, and the wide rows move once instead of once per column. A key that many rows share is
    hot on the left side of that join only, where it is split.
    """
    named = dimension.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    if named.count() <= SMALL:
        for name in columns:
            own = F.broadcast(named.toDF(f"_key_{name}", f"_found_{name}"))
            rows = rows.join(own, F.col(name) == F.col(f"_key_{name}"), "left").drop(f"_key_{name}")
        return rows
    stored = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "lookup_rows")
    wanted = stored.select("_row", F.posexplode(F.array(*columns)).alias("_which", "_key")).where("_key is not null")
    of_row = wanted.join(named, "_key").groupBy("_row").agg(
        *[F.max(F.when(F.col("_which") == at, F.col("_value"))).alias(f"_found_{name}") for at, name in enumerate(columns)]
    )
    return stored.join(of_row, "_row", "left").drop("_row")
