"""Catalogue queries: run listings, control rows, contract versions and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fixed_values as fixed
from ledgerloom.operators import merge
from ledgerloom.plans import ledger, runs
from ledgerloom.session import many_tasks, scratch_path
from ledgerloom.sources.keyed import KeyedTable
from suite import catalog_inputs  # noqa: F401  (registers the bindings)
from suite.lab import CHECKS, PARAMS, Lab
from suite.warehouse import NOW

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(Lab(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{value}'" for value in values) + ")"


CHECKS["latest_ok"] = f"""
SELECT final_table_name, run_id, created_at FROM {{app_runs}}
WHERE audit_passed AND split_part(final_table_name, '.', 1) IN {sql_list(fixed.RESULT_SCHEMAS)}
QUALIFY row_number() OVER (PARTITION BY final_table_name ORDER BY created_at DESC, run_id DESC) = 1"""


@query("latest_ok_run", "SELECT * FROM {latest_ok}")
def latest_ok_run(lab: Lab) -> DataFrame:
    return runs.latest_passing_runs(lab["app_runs"])


@query("latest_run", "SELECT run_id, created_at FROM {app_runs} ORDER BY created_at DESC LIMIT 1")
def latest_run(lab: Lab) -> DataFrame:
    return runs.latest_run(lab["app_runs"])


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("complementary_actions", F.array_join("complementary_actions", "; "))


CHECKS["listed"] = """
SELECT r.run_id, r.created_at, r.product_name, r.sql_file_name, r.final_table_name, r.target_table, r.audit_passed,
       CAST(json_extract_string(r.stats, '$.sources') AS BIGINT) AS source_count,
       CAST(json_extract_string(r.stats, '$.transformations') AS BIGINT) AS transformation_count,
       coalesce(c.include_in_catalog, FALSE) AS include_in_catalog, coalesce(c.review_status, 'pending') AS review_status,
       coalesce(array_to_string(c.complementary_actions, '; '), '') AS complementary_actions,
       coalesce(c.notes, '') AS notes, coalesce(c.last_import_status, 'idle') AS last_import_status,
       coalesce(c.last_import_result, '{{}}') AS last_import_result, c.last_operation_at, c.last_imported_at
FROM {app_runs} r LEFT JOIN {run_control} c ON c.run_id = r.run_id"""


@query("run_control_list", "SELECT * FROM {listed}")
def run_control_list(lab: Lab) -> DataFrame:
    return _shown(runs.run_list(lab["app_runs"], lab["run_control"], PARAMS.now))


@query(
    "run_search",
    """
SELECT * FROM {listed}
WHERE contains(lower(run_id || ' ' || product_name || ' ' || sql_file_name || ' ' || coalesce(target_table, '') || ' ' || notes),
               'nota purchase')""",
)
def run_search(lab: Lab) -> DataFrame:
    return _shown(runs.run_list(lab["app_runs"], lab["run_control"], PARAMS.now, search="  Nota PURCHASE "))


@query(
    "run_stats_json",
    """
SELECT run_id, CAST(json_extract_string(stats, '$.sources') AS BIGINT) AS sources,
       CAST(json_extract_string(stats, '$.transformations') AS BIGINT) AS transformations,
       replace(replace(stats, ': ', ':'), ', ', ',') AS stats
FROM {app_runs}""",
)
def run_stats_json(lab: Lab) -> DataFrame:
    return runs.stats_document(lab["app_runs"])


@query(
    "run_stats",
    """
SELECT run_id, count(*) FILTER (kind = 'source') AS sources, count(*) FILTER (kind = 'join') AS joins,
       count(*) FILTER (kind = 'filter') AS filters, count(*) FILTER (kind = 'transformation') AS transformations,
       count(*) FILTER (kind = 'rule') AS rules, count(*) FILTER (field_type = 'D') AS direct_fields,
       count(*) FILTER (field_type = 'T') AS derived_fields
FROM {analysis_items} GROUP BY run_id""",
)
def run_stats(lab: Lab) -> DataFrame:
    return runs.item_counts(lab["analysis_items"], ["source", "join", "filter", "transformation", "rule"])


CHECKS["ensured"] = f"""
SELECT run_id, include_in_catalog, review_status, complementary_actions, notes, last_import_status,
       last_operation_at, last_imported_at, last_import_result, created_at, updated_at
FROM {{run_control}}
UNION ALL
SELECT run_id, FALSE, 'pending', [], '', 'idle', NULL, NULL, '{{{{}}}}', {NOW}, {NOW}
FROM {{app_runs}} WHERE run_id NOT IN (SELECT run_id FROM {{run_control}})"""


@query(
    "control_ensure",
    "SELECT * REPLACE (array_to_string(complementary_actions, '; ') AS complementary_actions) FROM {ensured}",
)
def control_ensure(lab: Lab) -> DataFrame:
    return _shown(runs.ensure_control(lab["run_control"], lab["app_runs"], PARAMS.now))


@query("control_ensure_stored", ORACLES["control_ensure"])
def control_ensure_stored(lab: Lab) -> DataFrame:
    """The control table on disk; only partitions of runs without a row are written, and none when run again."""
    control = lab["run_control"]
    path, buckets = scratch_path(lab.spark, "control"), many_tasks(lab.spark)
    table = KeyedTable(lab.spark, path, control.schema, ("run_id",), parts=16, buckets=buckets)
    table.create(control)
    for _ in range(2):
        known = table.read().select("run_id")
        absent = lab["app_runs"].join(known, "run_id", "left_anti")
        table.insert_missing(runs.fresh_control(control.schema, absent, PARAMS.now))
    return _shown(table.read())


@query(
    "control_update",
    f"""
SELECT e.run_id, coalesce(k.include_in_catalog, e.include_in_catalog) AS include_in_catalog,
       coalesce(k.review_status, e.review_status) AS review_status,
       array_to_string(e.complementary_actions, '; ') AS complementary_actions,
       coalesce(k.notes, e.notes) AS notes, e.last_import_status, e.last_operation_at, e.last_imported_at,
       e.last_import_result, e.created_at, CASE WHEN k.run_id IS NULL THEN e.updated_at ELSE {NOW} END AS updated_at
FROM {{ensured}} e LEFT JOIN {{control_changes}} k ON k.run_id = e.run_id
WHERE k.run_id IS NOT NULL OR e.run_id IN (SELECT run_id FROM {{run_control}})""",
)
def control_update(lab: Lab) -> DataFrame:
    return _shown(runs.update_control(lab["run_control"], lab["control_changes"], lab["app_runs"], PARAMS.now))


@query(
    "import_state",
    """
SELECT run_id, arg_max(status, o) AS last_import_status, max(operation_at) AS last_operation_at,
       max(operation_at) FILTER (status = 'executed') AS last_imported_at, arg_max(result, o) AS last_import_result
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY operation_at, operation_id) AS o FROM {operations})
GROUP BY run_id""",
)
def import_state(lab: Lab) -> DataFrame:
    return runs.import_state(lab["operations"])


CHECKS["contract_rows"] = """
SELECT r.run_id, coalesce(r.target_table, r.final_table_name, '') AS table_name, r.product_name, r.sql_file_name,
       r.created_at AS updated_at, json_extract_string(r.storage_objects, '$.datacontract_yaml') AS storage_path,
       a.odcs_yaml
FROM {app_runs} r LEFT JOIN {run_analysis} a ON a.run_id = r.run_id"""

FILE_NAME = (
    "CASE WHEN storage_path IS NOT NULL THEN regexp_extract(storage_path, '[^/]*$') "
    "ELSE coalesce(nullif(trim(regexp_replace(table_name, '[^A-Za-z0-9._-]', '_', 'g'), '._'), ''), 'datacontract') "
    "|| '.odcs.yaml' END"
)


@query(
    "contracts_latest",
    f"""
SELECT run_id, table_name, product_name, sql_file_name, updated_at, {FILE_NAME} AS file_name, storage_path,
       coalesce(odcs_yaml, '') <> '' AS has_inline_yaml
FROM {{contract_rows}}
WHERE table_name <> '' AND (storage_path IS NOT NULL OR coalesce(odcs_yaml, '') <> '')
  AND contains(lower(concat_ws(' ', table_name, product_name, sql_file_name, storage_path)), 'cd_t1')
QUALIFY row_number() OVER (PARTITION BY lower(table_name) ORDER BY updated_at DESC, run_id DESC) = 1""",
)
def contracts_latest(lab: Lab) -> DataFrame:
    return runs.latest_contracts(lab["app_runs"], lab["run_analysis"], search="CD_T1")


@query(
    "contract_version",
    f"""
SELECT c.run_id, c.table_name, c.product_name, c.sql_file_name, c.updated_at, {FILE_NAME} AS file_name,
       c.storage_path, coalesce(nullif(c.odcs_yaml, ''), s.text, '') AS yaml_text
FROM {{contract_rows}} c LEFT JOIN {{stored_objects}} s ON s.path = c.storage_path""",
)
def contract_version(lab: Lab) -> DataFrame:
    return runs.contract_versions(lab["app_runs"], lab["run_analysis"], lab["stored_objects"])


CHECKS["versions"] = """
SELECT c.run_id, nullif(c.table_name, '') AS table_name, c.updated_at AS created_at,
       coalesce(nullif(c.odcs_yaml, ''), s.text, '') AS contract_json
FROM {contract_rows} c LEFT JOIN {stored_objects} s ON s.path = c.storage_path"""


@query(
    "contract_changes",
    """
SELECT run_id, table_name, created_at, h AS contract_hash,
       CASE WHEN before IS NULL THEN 'new' WHEN before = h THEN 'unchanged' ELSE 'changed' END AS change,
       after IS NOT NULL AS superseded
FROM (SELECT *, lag(h) OVER w AS before, lead(run_id) OVER w AS after
      FROM (SELECT *, sha256(contract_json) AS h FROM {versions})
      WINDOW w AS (PARTITION BY table_name ORDER BY created_at))""",
)
def contract_changes(lab: Lab) -> DataFrame:
    return runs.contract_changes(_versions(lab))


def _versions(lab: Lab) -> DataFrame:
    versions = runs.contract_versions(lab["app_runs"], lab["run_analysis"], lab["stored_objects"])
    return versions.select(
        "run_id",
        F.nullif("table_name", F.lit("")).alias("table_name"),
        F.col("updated_at").alias("created_at"),
        F.col("yaml_text").alias("contract_json"),
    )


def _seen_sql(versions: str) -> str:
    return f"""
SELECT 'run' AS kind, run_id AS identity, h AS content_hash, run_id, created_at, n > 1 AS superseded FROM {versions}
UNION ALL SELECT 'table', table_name, h, run_id, created_at, FALSE FROM {versions} WHERE n = 1
UNION ALL SELECT 'contract', h, h, max_by(run_id, (created_at, run_id)), max(created_at), FALSE FROM {versions} GROUP BY h"""


RANKED = """
SELECT run_id, table_name, created_at, sha256(contract_json) AS h,
       row_number() OVER (PARTITION BY table_name ORDER BY created_at DESC, run_id DESC) AS n FROM {versions}"""
# Runs of the first import; the second sees all.
EARLIER = "created_at < TIMESTAMP '1997-01-01'"
CHECKS["seen_before"] = f"WITH v AS ({RANKED} WHERE {EARLIER}) {_seen_sql('v')}"
CHECKS["seen_now"] = f"WITH v AS ({RANKED}) {_seen_sql('v')}"


@query(
    "import_delta",
    """
SELECT n.kind, n.identity, n.content_hash, n.run_id, n.created_at, n.superseded, b.content_hash AS before_hash,
       CASE WHEN b.kind IS NULL THEN 'new' WHEN b.content_hash <> n.content_hash THEN 'changed' ELSE 'superseded' END AS change
FROM {seen_now} n LEFT JOIN {seen_before} b ON b.kind = n.kind AND b.identity IS NOT DISTINCT FROM n.identity
WHERE b.kind IS NULL OR b.content_hash <> n.content_hash OR (n.superseded AND NOT b.superseded)""",
)
def import_delta(lab: Lab) -> DataFrame:
    """Early runs are taken into the ledger, then all; what comes out the second time are the differences."""
    versions = _versions(lab)
    table = ledger.ledger_table(lab.spark, scratch_path(lab.spark, "ledger"), parts=16, buckets=many_tasks(lab.spark))
    table.create(lab.spark.createDataFrame([], ledger.SCHEMA))
    ledger.take_in(table, ledger.observations(versions.where(EARLIER)))
    return ledger.take_in(table, ledger.observations(versions))


# Section, its table, the column that orders its rows, and its own columns.
SECTIONS = [
    ("app_run", "app_runs", "0", ["product_name", "sql_file_name", "final_table_name", "target_table", "status"]),
    ("run_analysis", "run_analysis", "0", ["odcs_yaml"]),
    ("run_audit_findings", "numbered_findings", "id", ["severity", "message"]),
    ("run_sources", "run_module_sources", "pos", ["source_alias", "source_table", "source_kind"]),
    ("run_transformations", "run_transformations", "pos", ["field_name", "origin"]),
    ("run_modules", "run_modules", "module_key", ["module_name", "sql_file_name", "target_table"]),
    ("run_module_sources", "run_module_sources", "pos", ["module_key", "source_alias", "source_table"]),
    ("run_module_transformations", "run_transformations", "pos", ["module_key", "field_name", "origin"]),
    ("run_pipeline_relations", "run_relations", "id", ["source_node", "target_node", "relation_label"]),
    ("run_workspace_files", "run_files", "pos", ["relative_path", "size_bytes"]),
]
MODULE_NUMBER = "CAST(substr(module_key, 6) AS BIGINT)"

CHECKS["numbered_findings"] = """
SELECT run_id, CASE severity WHEN 'error' THEN 1 ELSE 2 END AS id, severity, message FROM {run_findings}"""


def _bundle_sql() -> str:
    parts = []
    for name, table, order, columns in SECTIONS:
        place = MODULE_NUMBER if order == "module_key" else order
        packed = ", ".join(["id := id_", *[f"{c} := {c}" for c in columns]])
        parts.append(
            f"SELECT run_id, '{name}' AS section, id_ AS id, CAST(to_json(struct_pack({packed})) AS VARCHAR) AS row_json "
            f"FROM (SELECT *, CAST({place} AS BIGINT) AS id_ FROM {{{table}}})"
        )
    parts.append(
        "SELECT run_id, 'run_audit_summary', 0, CAST(to_json(struct_pack(id := CAST(0 AS BIGINT), error_count := "
        "count(*) FILTER (severity = 'error'), warning_count := count(*) FILTER (severity = 'warning'))) AS VARCHAR) "
        "FROM {run_findings} GROUP BY run_id"
    )
    parts.append(
        "SELECT c.run_id, 'datacontract_version', 0, CAST(to_json(struct_pack(id := CAST(0 AS BIGINT), "
        "table_name := c.table_name, yaml_text := coalesce(nullif(c.odcs_yaml, ''), s.text, ''))) AS VARCHAR) "
        "FROM {contract_rows} c LEFT JOIN {stored_objects} s ON s.path = c.storage_path"
    )
    return " UNION ALL ".join(parts)


@query("run_bundle", _bundle_sql())
def run_bundle(lab: Lab) -> DataFrame:
    place = F.when(F.col("severity") == "error", 1).otherwise(2)
    tables = {"numbered_findings": lab["run_findings"].withColumn("id", place)}
    sections = {}
    for name, table, order, columns in SECTIONS:
        rows = tables[table] if table in tables else lab[table]
        at = F.expr(MODULE_NUMBER if order == "module_key" else order).cast("bigint")
        sections[name] = rows.select("run_id", at.alias("id"), *columns)
    kinds = lab["run_findings"].groupBy("run_id").agg(
        F.lit(0).cast("bigint").alias("id"),
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
    )
    versions = runs.contract_versions(lab["app_runs"], lab["run_analysis"], lab["stored_objects"])
    contract = versions.select("run_id", F.lit(0).cast("bigint").alias("id"), "table_name", "yaml_text")
    return runs.run_sections(sections | {"run_audit_summary": kinds, "datacontract_version": contract})


CHECKS["renewed"] = """
SELECT run_id, module_key, pos, upper(source_table) AS source_table FROM {run_module_sources}
WHERE CAST(right(run_id, 1) AS INT) = 3 AND pos % 2 = 0"""


@query(
    "run_slice_replace",
    """
SELECT run_id, module_key, pos, source_table FROM {run_module_sources} s ANTI JOIN {renewed} r USING (run_id)
UNION ALL SELECT * FROM {renewed}""",
)
def run_slice_replace(lab: Lab) -> DataFrame:
    """Source rows of some runs written anew: all old rows of those runs go."""
    base = lab["run_module_sources"].select("run_id", "module_key", "pos", "source_table")
    some = base.where("CAST(right(run_id, 1) AS INT) = 3 AND pos % 2 = 0")
    return merge.replace_slice(base, some.withColumn("source_table", F.upper("source_table")), ["run_id"])


def _stored_sources(lab: Lab) -> KeyedTable:
    rows = lab["run_module_sources"].select("run_id", "module_key", "pos", "source_table")
    path, keys = scratch_path(lab.spark, "run_sources"), ("run_id", "module_key", "pos")
    table = KeyedTable(lab.spark, path, rows.schema, keys, parts=16, by=("run_id",), buckets=many_tasks(lab.spark))
    table.create(rows)
    return table


@query("run_slice_stored", ORACLES["run_slice_replace"])
def run_slice_stored(lab: Lab) -> DataFrame:
    """As above, on disk: the new rows are made from the table that they change."""
    table = _stored_sources(lab)
    some = table.read().where("CAST(right(run_id, 1) AS INT) = 3 AND pos % 2 = 0")
    table.replace_slices(some.withColumn("source_table", F.upper("source_table")))
    return table.read()


@query(
    "run_slice_delete",
    """
SELECT run_id, module_key, pos, source_table FROM {run_module_sources}
WHERE run_id NOT IN (SELECT run_id FROM {run_control} WHERE last_import_status = 'planned')""",
)
def run_slice_delete(lab: Lab) -> DataFrame:
    """Rows of runs whose import is only planned are removed from the table on disk."""
    table = _stored_sources(lab)
    for _ in range(2):
        table.delete_slices(lab["run_control"].where("last_import_status = 'planned'"))
    return table.read()
