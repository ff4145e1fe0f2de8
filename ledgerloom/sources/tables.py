"""Publishing datasets as tables, the way the warehouse scripts do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.naming import tabular_type
from ledgerloom.session import setting


def analyze(spark: SparkSession, table: str, columns: bool = True) -> None:
    """Gather row counts and, of all columns, ranges, distinct counts and equal-height histograms, for the optimizer.

    With them it knows how many rows a filter or a join leaves, and puts joins in order by that (``session.SQL_SETTINGS``).
    """
    if not columns:
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
        return
    with setting(spark, "spark.sql.statistics.histogram.enabled", "true"):
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def refresh(spark: SparkSession, table: str) -> None:
    """Forget cached file listings after another job wrote the table."""
    spark.catalog.refreshTable(table)


def publish_overwrite(df: DataFrame, table: str, path: str | None = None) -> None:
    """Replace the whole content of a Parquet table, then gather statistics."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    analyze(df.sparkSession, table)


def publish_ctas(df: DataFrame, table: str, path: str | None = None) -> None:
    """Drop the table if it exists and create it from a query, then gather statistics."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    location = f"LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE {table} USING parquet {location} AS SELECT * FROM {{df}}", df=df)
    analyze(spark, table)


def publish_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Replace a table whose rows lie in buckets of ``key``, sorted by it, one file each, then gather row counts.

    Tables with the same number of buckets on their join key are joined without moving a row. Rows meet in one
    task by key, so the key must be one that no value of which has a large share of the rows, such as an account number;
    a customer number that many rows lack or share is joined after a shuffle, which splits such values.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    analyze(df.sparkSession, table, columns=False)


def publish_partitions(df: DataFrame, table: str, by: Sequence[str], path: str | None = None) -> None:
    """Replace only the partitions present in ``df``; the table is created on first use.

    Rows are rebalanced by partition value before the write: small values share files, and a
    value that holds a third of the data is split over several tasks.
    """
    spark = df.sparkSession
    ordered = df.select(*[c for c in df.columns if c not in by], *by).hint("rebalance", *by)
    if spark.catalog.tableExists(table):
        with setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            ordered.write.mode("overwrite").insertInto(table)
    else:
        writer = ordered.write.format("parquet").partitionBy(*by)
        (writer.option("path", path) if path else writer).saveAsTable(table)
    refresh(spark, table)
    analyze(spark, table, columns=False)


def write_report(df: DataFrame, parameter: str, path: str) -> None:
    """One CSV folder per value of a parameter."""
    df.write.mode("overwrite").partitionBy(parameter).option("header", True).csv(path)


def column_profile(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per column: type, whether required, first non-null value by ``order``, row and null counts.

    All come from one aggregate over the table.
    """
    named = [(field.name, field.dataType.simpleString().upper(), not field.nullable) for field in df.schema]
    firsts = [
        F.min_by(F.col(name).cast("string"), F.when(F.col(name).isNotNull(), F.struct(*order))) for name, _, _ in named
    ]
    filled = [F.count(name) for name, _, _ in named]
    counts = df.agg(F.count("*").alias("_rows"), F.array(*firsts).alias("_first"), F.array(*filled).alias("_filled"))
    profiles = [
        F.struct(
            F.lit(index).alias("position"),
            F.lit(name).alias("field_name"),
            F.lit(kind).alias("physical_type"),
            tabular_type(F.lit(kind)).alias("logical_type"),
            F.lit(required).alias("required"),
            F.col("_first")[index - 1].alias("example"),
            F.col("_rows").alias("row_count"),
            (F.col("_rows") - F.col("_filled")[index - 1]).alias("null_count"),
        )
        for index, (name, kind, required) in enumerate(named, start=1)
    ]
    return counts.select(F.inline(F.array(*profiles)))
