"""The run catalogue: listings, control rows, statistics, contract versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.functions import fixed_values as fixed
from ledgerloom.functions.columns import newest
from ledgerloom.functions.naming import contract_file_name
from ledgerloom.operators.merge import insert_missing, patch, with_default
from ledgerloom.operators.rows import best_by, previous, with_groups

STATS = "sources bigint, transformations bigint"
STORED = "datacontract_yaml string"


def _newest_runs(runs: DataFrame, most: int | None) -> DataFrame:
    """All runs, or only the newest if a caller asks for so many."""
    return runs if most is None else runs.orderBy(newest("created_at"), newest("run_id")).limit(most)


def latest_run(runs: DataFrame) -> DataFrame:
    return _newest_runs(runs.select("run_id", "created_at"), 1)


def latest_passing_runs(runs: DataFrame, schemas: Sequence[str] = tuple(fixed.RESULT_SCHEMAS)) -> DataFrame:
    """Newest run with a passed audit per final table of the allowed schemas."""
    table = F.col("final_table_name")
    passing = runs.where(
        F.col("audit_passed") & table.isNotNull() & F.split_part(table, F.lit("."), F.lit(1)).isin(*schemas)
    ).select("final_table_name", "run_id", "created_at")
    return best_by(passing, ["final_table_name"], [newest("created_at"), newest("run_id")])


def control_defaults(now: Column) -> dict[str, Column]:
    """The control row shown or created for a run that has none."""
    return {
        "include_in_catalog": F.lit(False),
        "review_status": F.lit("pending"),
        "complementary_actions": F.array().cast("array<string>"),
        "notes": F.lit(""),
        "last_import_status": F.lit("idle"),
        "last_import_result": F.lit("{}"),
    }


def _matches(search: str, columns: Sequence[Column]) -> Column:
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))
    return text.contains(search.strip().lower())


def run_list(
    runs: DataFrame,
    control: DataFrame,
    now: Column,
    search: str = "",
    limit: int | None = None,
    scan: int | None = None,
) -> DataFrame:
    """Runs with their control row (or its default) and counts from the stats document.

    All runs are listed and searched. A caller may ask for the newest ``limit`` of those found, or to search only the
    newest ``scan``.
    """
    fields = ["last_operation_at", "last_imported_at"]
    newest_runs = _newest_runs(runs, scan)
    listed = with_default(
        newest_runs,
        control.select("run_id", *control_defaults(now), *fields),
        ["run_id"],
        control_defaults(now),
    )
    stats = F.from_json("stats", STATS)
    rows = listed.select(
        "run_id",
        "created_at",
        "product_name",
        "sql_file_name",
        "final_table_name",
        "target_table",
        F.coalesce("audit_passed", F.lit(False)).alias("audit_passed"),
        F.coalesce(stats["sources"], F.lit(0)).alias("source_count"),
        F.coalesce(stats["transformations"], F.lit(0)).alias("transformation_count"),
        *control_defaults(now),
        *fields,
    )
    if search.strip():
        haystack = ["run_id", "product_name", "sql_file_name", "target_table", "notes"]
        rows = rows.where(_matches(search, [F.col(name) for name in haystack]))
    return _newest_runs(rows, limit)


def stats_document(runs: DataFrame) -> DataFrame:
    """The stats document of every run, read into columns and written back as JSON."""
    stats = F.from_json("stats", STATS)
    return runs.select(
        "run_id",
        stats["sources"].alias("sources"),
        stats["transformations"].alias("transformations"),
        F.to_json(stats).alias("stats"),
    )


def item_counts(items: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Rows per kind and direct / derived fields per run, in one pass."""
    kind, field = F.col("kind"), F.col("field_type")
    return items.groupBy("run_id").agg(
        *[F.count_if(kind == name).alias(f"{name}s") for name in kinds],
        F.count_if((kind == "transformation") & (field == "D")).alias("direct_fields"),
        F.count_if((kind == "transformation") & (field == "T")).alias("derived_fields"),
    )


def fresh_control(schema: StructType, runs: DataFrame, now: Column) -> DataFrame:
    """A default control row for every run."""
    values = control_defaults(now)
    fresh = runs.select("run_id").distinct()
    for field in schema:
        if field.name != "run_id":
            value = values.get(field.name, now if field.name in ("created_at", "updated_at") else F.lit(None))
            fresh = fresh.withColumn(field.name, value.cast(field.dataType))
    return fresh


def ensure_control(control: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Control rows with a default added for every run that has none."""
    return insert_missing(control, fresh_control(control.schema, runs, now), ["run_id"])


def update_control(control: DataFrame, changes: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Apply changes to control rows, creating missing ones; a NULL change keeps the current value."""
    stamped = changes.withColumn("updated_at", now)
    return patch(ensure_control(control, runs.join(changes, "run_id", "left_semi"), now), stamped, ["run_id"])


def import_state(operations: DataFrame) -> DataFrame:
    """Outcome of the last operation per run, and when a run was last really imported.

    Both are maxima, so each task sends one row per run to the shuffle.
    """
    outcome = F.struct("operation_at", "operation_id", "status", "result")
    return (
        operations.groupBy("run_id")
        .agg(
            F.max(outcome).alias("last"),
            F.max(F.when(F.col("status") == "executed", F.col("operation_at"))).alias("last_imported_at"),
        )
        .select(
            "run_id",
            F.col("last.status").alias("last_import_status"),
            F.col("last.operation_at").alias("last_operation_at"),
            "last_imported_at",
            F.col("last.result").alias("last_import_result"),
        )
    )


def _table_name() -> Column:
    """Target table of a run, else its final table; a blank target does not fall through."""
    return F.trim(F.coalesce(F.nullif("target_table", F.lit("")), "final_table_name", F.lit("")))


def _file_name(path: Column, table: Column) -> Column:
    from_path = F.element_at(F.split(path, "/"), -1)
    return F.when(F.coalesce(path, F.lit("")) != "", from_path).otherwise(contract_file_name(table))


def latest_contracts(
    runs: DataFrame, analysis: DataFrame, search: str = "", limit: int | None = None, scan: int | None = None
) -> DataFrame:
    """Newest contract per table: runs with a contract, those found, the first per table.

    As in :func:`run_list`, ``scan`` and ``limit`` bound the runs looked at and returned only where a caller asks for it.
    """
    listed = _newest_runs(runs, scan).join(analysis.select("run_id", "odcs_yaml"), "run_id", "left")
    path = F.from_json("storage_objects", STORED)["datacontract_yaml"]
    has_path, has_text = F.coalesce(path, F.lit("")) != "", F.coalesce("odcs_yaml", F.lit("")) != ""
    rows = listed.select(
        "run_id",
        _table_name().alias("table_name"),
        "product_name",
        "sql_file_name",
        F.col("created_at").alias("updated_at"),
        _file_name(path, _table_name()).alias("file_name"),
        path.alias("storage_path"),
        has_text.alias("has_inline_yaml"),
        (has_path | has_text).alias("_has_contract"),
    ).where((F.col("table_name") != "") & F.col("_has_contract"))
    if search.strip():
        haystack = ["table_name", "product_name", "sql_file_name", "storage_path"]
        rows = rows.where(_matches(search, [F.col(name) for name in haystack]))
    first = best_by(
        rows.withColumn("_table", F.lower("table_name")), ["_table"], [newest("updated_at"), newest("run_id")]
    )
    kept = first if limit is None else first.orderBy(newest("updated_at"), newest("run_id")).limit(limit)
    return kept.drop("_table", "_has_contract")


def contract_versions(runs: DataFrame, analysis: DataFrame, stored: DataFrame) -> DataFrame:
    """Contract text of every run: the inline text, else the stored object's."""
    path = F.from_json("storage_objects", STORED)["datacontract_yaml"]
    objects = stored.select(F.col("path").alias("storage_path"), F.col("text").alias("_stored"))
    return (
        runs.withColumn("storage_path", path)
        .join(analysis.select("run_id", "odcs_yaml"), "run_id", "left")
        .join(objects, "storage_path", "left")
        .select(
            "run_id",
            _table_name().alias("table_name"),
            "product_name",
            "sql_file_name",
            F.col("created_at").alias("updated_at"),
            _file_name(F.col("storage_path"), _table_name()).alias("file_name"),
            "storage_path",
            F.coalesce(F.nullif("odcs_yaml", F.lit("")), "_stored", F.lit("")).alias("yaml_text"),
        )
    )


def contract_changes(versions: DataFrame) -> DataFrame:
    """Each contract version against the one before it, and whether a newer one replaced it.

    ``versions`` has run_id, table_name, created_at (unique per table) and contract_json.
    """
    hashed = versions.select(
        "run_id", "table_name", "created_at", F.sha2("contract_json", 256).alias("contract_hash")
    )
    compared = previous(hashed, ["table_name"], "created_at", "contract_hash", "_before")
    latest = hashed.groupBy("table_name").agg(F.max("created_at").alias("_latest"))
    return with_groups(compared, latest, ["table_name"]).select(
        "run_id",
        "table_name",
        "created_at",
        "contract_hash",
        F.when(F.col("_before").isNull(), "new")
        .when(F.col("_before") == F.col("contract_hash"), "unchanged")
        .otherwise("changed")
        .alias("change"),
        (F.col("created_at") < F.col("_latest")).alias("superseded"),
    )


def run_sections(sections: Mapping[str, DataFrame]) -> DataFrame:
    """Detail rows of every run as JSON, one row each, named by section and ``id`` within it.

    Each section has run_id and an integer ``id``, whose order is the order of the section's rows.
    """
    united = None
    for name, df in sections.items():
        rest = [c for c in df.columns if c != "run_id"]
        rows = df.select(
            "run_id",
            F.lit(name).alias("section"),
            F.col("id").cast("bigint").alias("id"),
            F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("row_json"),
        )
        united = rows if united is None else united.unionByName(rows)
    return united
