"""Schema catalogue and source registry: load, classify, build, validate, merge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fixed_values as fixed
from ledgerloom.functions.naming import (
    blank_to_null,
    is_temporary,
    leaf_name,
    physical_names,
    schema_type,
    split_first_dot,
)
from ledgerloom.operators.merge import upsert
from ledgerloom.operators.rows import first_wins

REGISTRY_KEYS = ["run_id", "target_table", "source_table"]


def schema_catalog(raw: DataFrame, source_name: str, order: str | None = None) -> DataFrame:
    """Typed schema rows from the columns esquema, descripcion and proposito; nameless rows drop out.

    One row per schema: the last by the column ``order``, or without one the largest by description and purpose.
    """
    name = F.trim("esquema")
    kind = schema_type(F.col("proposito"))
    last = [F.col(order).cast("bigint")] if order else []
    last += [F.coalesce(c, F.lit("")) for c in ("proposito", "descripcion")]
    raw = raw.groupBy(name.alias("esquema")).agg(
        F.max_by(F.struct("descripcion", "proposito"), F.struct(*last)).alias("_row")
    ).select("esquema", "_row.*")
    return raw.where(F.coalesce(name, F.lit("")) != "").select(
        name.alias("schema_name"),
        blank_to_null(F.col("descripcion")).alias("description"),
        blank_to_null(F.col("proposito")).alias("business_purpose"),
        kind.alias("schema_type"),
        is_temporary(name, kind).alias("is_temporary"),
        F.lit(True).alias("include_in_catalog"),
        F.lit(source_name).alias("source_file_name"),
    )


def clean_sources(assets: DataFrame, relations: DataFrame, controlled: DataFrame | None = None) -> DataFrame:
    """Physical source tables per run, first mention first, filled up from lineage edges.

    ``assets`` has run_id, pos, qualified_name and source_kind; ``relations`` run_id, id,
    source_node and source_kind. Runs in ``controlled`` take nothing from their edges.
    """
    kind = F.lower(F.trim(F.coalesce("source_kind", F.lit(""))))
    named = assets.where(kind.isin("", "table", "view")).select(
        "run_id",
        F.lit(0).alias("rank"),
        "pos",
        F.explode(physical_names(F.col("qualified_name"))).alias("qualified_name"),
        kind.alias("source_kind"),
    )
    edges = relations.where(kind.isin("table", "view")).select(
        "run_id",
        F.lit(1).alias("rank"),
        F.col("id").alias("pos"),
        F.explode(physical_names(F.col("source_node"))).alias("qualified_name"),
        kind.alias("source_kind"),
    )
    if controlled is not None:
        edges = edges.join(controlled.select("run_id").distinct(), "run_id", "left_anti")
    # Moved by run, so what joins the targets of the runs later does not move again.
    found = named.unionByName(edges).repartition("run_id")
    first = first_wins(found, ["run_id", "qualified_name"], ["rank", "pos", "source_kind"])
    return first.select(
        "run_id", "rank", "pos", "qualified_name", leaf_name(F.col("qualified_name")).alias("display_name"), "source_kind"
    )


def build_registry(sources: DataFrame, targets: DataFrame, schemas: DataFrame) -> DataFrame:
    """Registry rows of cleaned sources; temporary schemas are left out of the catalogue.

    The schema catalogue has one row per schema and is joined on the name before the first dot. Sources of runs without
    a target stay, with an empty one.
    """
    return registry_columns(matched_sources(sources, targets, schemas))


def matched_sources(sources: DataFrame, targets: DataFrame, schemas: DataFrame) -> DataFrame:
    """Cleaned sources with the target of their run and the type of their schema: what registry rows are made from."""
    source_schema, _ = split_first_dot(F.col("source_table"))
    kinds = schemas.select(F.col("schema_name").alias("source_schema"), F.col("schema_type").alias("_kind"))
    return (
        sources.select("run_id", F.trim("qualified_name").alias("source_table"), "source_kind")
        .join(targets.select("run_id", "target_table"), "run_id", "left")
        .withColumn("target_table", F.coalesce("target_table", F.lit("")))
        .withColumn("source_schema", source_schema)
        .join(kinds, "source_schema", "left")
        .drop("source_schema")
    )


def registry_columns(rows: DataFrame) -> DataFrame:
    """Registry rows of matched sources; all columns follow from a row's own."""
    source_schema, source_object = split_first_dot(F.col("source_table"))
    target_schema, target_object = split_first_dot(F.col("target_table"))
    temporary = is_temporary(F.coalesce(source_schema, "source_table"), F.col("_kind"))
    return rows.select(
        "run_id",
        "target_table",
        "source_table",
        target_schema.alias("target_schema"),
        target_object.alias("target_object_name"),
        source_schema.alias("source_schema"),
        source_object.alias("source_object_name"),
        F.nullif("_kind", F.lit("")).alias("source_schema_type"),
        "source_kind",
        temporary.alias("is_temporary"),
        (~temporary).alias("include_in_catalog"),
        F.lit("candidate").alias("review_status"),
        F.lit("auto").alias("decision_source"),
    )


def registry_defaults(now: Column) -> dict[str, Column]:
    """Values of the columns that a new registry row does not bring along."""
    return {
        "review_status": F.lit("candidate"),
        "decision_source": F.lit("auto"),
        "loaded_at": now,
        "is_temporary": F.lit(False),
        "include_in_catalog": F.lit(True),
    }


def merge_registry(base: DataFrame, delta: DataFrame, now: Column) -> DataFrame:
    """Merge new registry rows on run, target and source; a column the change lacks keeps its value."""
    return upsert(base, delta, REGISTRY_KEYS, registry_defaults(now))


def ready_rows(registry: DataFrame) -> DataFrame:
    """Registry rows that may be published."""
    return registry.where(F.col("include_in_catalog") & F.col("review_status").isin("candidate", "approved"))


# Allowed values per column of the registry and of the control table.
REGISTRY_RULES = {"review_status": fixed.SOURCE_REVIEWS, "source_schema_type": fixed.SCHEMA_TYPES}
CONTROL_RULES = {"review_status": fixed.RUN_REVIEWS, "last_import_status": fixed.IMPORT_STATES}


def invalid_rows(rows: DataFrame, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows that break an allowed-value rule, with every column that breaks one.

    As with a CHECK constraint, a missing value breaks none.
    """
    broken = [F.when(~F.col(name).isin(list(allowed)), F.lit(name)) for name, allowed in rules.items()]
    return rows.withColumn("broken_rules", F.concat_ws(", ", *broken)).where("broken_rules != ''")


def overlay_assets(assets: DataFrame, ready: DataFrame) -> DataFrame:
    """Per run, source assets give way to registry rows where the registry has any.

    Targets and files stay. Runs the registry does not know keep their assets unchanged.
    """
    listed = ready.where(F.coalesce(F.trim("source_table"), F.lit("")) != "")
    known = listed.select("run_id").distinct()
    is_source = (F.col("asset_type") == "dataset") & (F.col("role") == "source")
    stay = assets.where(~is_source).unionByName(assets.where(is_source).join(known, "run_id", "left_anti"))
    name = F.trim("source_table")
    from_registry = listed.select(
        "run_id",
        F.lit("dataset").alias("asset_type"),
        name.alias("qualified_name"),
        F.trim(F.coalesce(F.nullif("source_object_name", F.lit("")), leaf_name(name))).alias("display_name"),
        F.lit("source").alias("role"),
        F.coalesce(F.nullif("source_kind", F.lit("")), F.lit("table")).alias("source_kind"),
    )
    columns = from_registry.columns
    return stay.select(*columns).unionByName(from_registry)
