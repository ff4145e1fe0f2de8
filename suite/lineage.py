"""Registry, bundle and lineage queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fixed_values as fixed
from ledgerloom.plans import bundle, lineage, registry, runs
from ledgerloom.session import many_tasks, scratch_path
from ledgerloom.sources import text
from ledgerloom.sources.keyed import KeyedTable
from suite.catalog import sql_list
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


# ---------------------------------------------------------------- schema catalogue and registry


def sql_schema_type(x: str) -> str:
    name = f"upper(trim(coalesce({x}, '')))"
    return f"CASE WHEN {name} = '' THEN 'NO CLASIFICADO' WHEN {name} IN {sql_list(fixed.SCHEMA_TYPES)} THEN {name} ELSE 'OTRO' END"


def sql_temporary(schema: str, kind: str) -> str:
    return f"({kind} = 'TEMPORAL' OR regexp_matches(lower(trim({schema})), '^(tmp_|stg_)|_tmp$'))"


CHECKS["schema_catalog"] = f"""
SELECT schema_name, nullif(trim(descripcion), '') AS description, nullif(trim(proposito), '') AS business_purpose,
       kind AS schema_type, {sql_temporary('schema_name', 'kind')} AS is_temporary, TRUE AS include_in_catalog,
       'esquemas.csv' AS source_file_name
FROM (SELECT *, trim(esquema) AS schema_name, {sql_schema_type('proposito')} AS kind FROM {{schema_rows}})
WHERE schema_name <> ''
QUALIFY row_number() OVER (PARTITION BY schema_name ORDER BY fila DESC) = 1"""


@query("schema_catalog_load", "SELECT * FROM {schema_catalog}")
def schema_catalog_load(lab: Lab) -> DataFrame:
    """The rows are first written as CSV with a byte order mark, then loaded from it."""
    path = scratch_path(lab.spark, "schemas")
    lab["schema_rows"].withColumnRenamed("esquema", text.MARK + "esquema").write.option("header", True).csv(path)
    return registry.schema_catalog(text.read_csv(lab.spark, path), "esquemas.csv", order="fila")


def sql_physical(x: str) -> str:
    base = f"trim(split_part(trim(split_part(trim(split_part(trim({x}), '(', 1)), ' AS ', 1)), ' as ', 1))"
    rejected = f"regexp_matches(lower(trim({x})), '^cte |subconsulta|derivada de|,')"
    return f"CASE WHEN NOT {rejected} AND NOT contains({base}, ' ') AND contains({base}, '.') THEN {base} END"


CHECKS["clean"] = f"""
SELECT run_id, rank, pos, qualified_name, regexp_extract(qualified_name, '[^.]*$') AS display_name, source_kind
FROM (
  SELECT run_id, 0 AS rank, pos, {sql_physical('source_table')} AS qualified_name, source_kind
  FROM {{run_module_sources}} WHERE source_kind IN ('', 'table', 'view')
  UNION ALL
  SELECT run_id, 1, id, {sql_physical('source_node')}, source_kind FROM {{run_relations}}
  WHERE source_kind IN ('table', 'view') AND run_id NOT IN (SELECT run_id FROM {{registry_base}}))
WHERE qualified_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY run_id, qualified_name ORDER BY rank, pos, source_kind) = 1"""


def _clean(lab: Lab, controlled: DataFrame | None = None) -> DataFrame:
    named = lab["run_module_sources"].withColumnRenamed("source_table", "qualified_name")
    return registry.clean_sources(named, lab["run_relations"], lab["registry_base"] if controlled is None else controlled)


@query("source_clean", "SELECT * FROM {clean}")
def source_clean(lab: Lab) -> DataFrame:
    return _clean(lab)


CHECKS["registry"] = f"""
SELECT run_id, target_table, source_table, nullif(split_part(target_table, '.', 1), '') AS target_schema,
       nullif(split_part(target_table, '.', 2), '') AS target_object_name, source_schema,
       substr(source_table, length(source_schema) + 2) AS source_object_name, kind AS source_schema_type, source_kind,
       tmp AS is_temporary, NOT tmp AS include_in_catalog, 'candidate' AS review_status, 'auto' AS decision_source
FROM (
  SELECT *, coalesce(kind = 'TEMPORAL', FALSE) OR regexp_matches(source_schema, '^(tmp_|stg_)|_tmp$') AS tmp
  FROM (
    SELECT c.run_id, coalesce(r.target_table, '') AS target_table, c.qualified_name AS source_table, split_part(c.qualified_name, '.', 1) AS source_schema,
           c.source_kind, s.schema_type AS kind
    FROM {{clean}} c LEFT JOIN {{app_runs}} r ON r.run_id = c.run_id
    LEFT JOIN {{schema_catalog}} s ON s.schema_name = split_part(c.qualified_name, '.', 1)))"""


def _schemas(lab: Lab) -> DataFrame:
    return registry.schema_catalog(lab["schema_rows"], "esquemas.csv", order="fila")


def _registry(lab: Lab) -> DataFrame:
    return registry.build_registry(_clean(lab), lab["app_runs"], _schemas(lab))


@query("registry_build", "SELECT * FROM {registry}")
def registry_build(lab: Lab) -> DataFrame:
    return _registry(lab)


@query(
    "registry_upsert",
    f"""
SELECT run_id, target_table, source_table, source_schema, source_object_name, source_schema_type, source_kind,
       is_temporary, include_in_catalog, review_status, decision_source, coalesce(b.loaded_at, {NOW}) AS loaded_at
FROM {{registry}} LEFT JOIN (SELECT run_id, target_table, source_table, loaded_at FROM {{registry_base}}) b
  USING (run_id, target_table, source_table)
UNION ALL
SELECT b.* FROM {{registry_base}} b ANTI JOIN {{registry}} r USING (run_id, target_table, source_table)""",
)
def registry_upsert(lab: Lab) -> DataFrame:
    return registry.merge_registry(lab["registry_base"], _registry(lab), PARAMS.now)


@query("registry_upsert_stored", ORACLES["registry_upsert"])
def registry_upsert_stored(lab: Lab) -> DataFrame:
    """The registry as a table on disk, with the new rows merged into the partitions they touch; twice, as a retry does."""
    base, keys = lab["registry_base"], tuple(registry.REGISTRY_KEYS)
    path, buckets = scratch_path(lab.spark, "registry"), many_tasks(lab.spark)
    table = KeyedTable(lab.spark, path, base.schema, keys, parts=16, by=("run_id",), buckets=buckets)
    table.create(base)
    matched = registry.matched_sources(_clean(lab, table.read()), lab["app_runs"], _schemas(lab))
    delta = table.staged(matched, registry.registry_columns)
    for _ in range(2):
        table.upsert(delta, registry.registry_defaults(PARAMS.now))
    return table.read()


READY = "include_in_catalog AND review_status IN ('candidate', 'approved')"


@query("registry_ready", f"SELECT * FROM {{registry_base}} WHERE {READY}")
def registry_ready(lab: Lab) -> DataFrame:
    view = f"source_registry_ready_{uuid.uuid4().hex}"
    registry.ready_rows(lab["registry_base"]).createOrReplaceTempView(view)
    return lab.spark.table(view)


@query(
    "registry_validate",
    f"""
SELECT *, concat_ws(', ', CASE WHEN review_status NOT IN {sql_list(fixed.SOURCE_REVIEWS)} THEN 'review_status' END,
                          CASE WHEN source_schema_type NOT IN {sql_list(fixed.SCHEMA_TYPES)} THEN 'source_schema_type' END)
       AS broken_rules
FROM {{registry_base}}
WHERE review_status NOT IN {sql_list(fixed.SOURCE_REVIEWS)} OR source_schema_type NOT IN {sql_list(fixed.SCHEMA_TYPES)}""",
)
def registry_validate(lab: Lab) -> DataFrame:
    return registry.invalid_rows(lab["registry_base"], registry.REGISTRY_RULES)


# ---------------------------------------------------------------- bundle

CATEGORY = """CASE lower(split_part(relative_path, '/', 1)) WHEN 'sql' THEN 'sql' WHEN 'metadata' THEN 'metadata'
     WHEN 'templates' THEN 'template' ELSE CASE lower(relative_path) WHEN 'config.yml' THEN 'config' ELSE 'other' END END"""

CHECKS["assets"] = f"""
SELECT run_id, asset_type, qualified_name, display_name, description, tags, role, source_kind, file_category, size_bytes,
       storage_path
FROM (
  SELECT r.run_id, 0 AS rank, 0 AS pos, 'dataset' AS asset_type, target_table AS qualified_name,
         coalesce(c.schema_name, target_table) AS display_name, c.schema_description AS description,
         coalesce(c.tags, []) AS tags, 'target' AS role, NULL AS source_kind, NULL AS file_category, NULL AS size_bytes,
         NULL AS storage_path
  FROM {{app_runs}} r LEFT JOIN {{asset_contracts}} c ON c.run_id = r.run_id WHERE coalesce(target_table, '') <> ''
  UNION ALL
  SELECT run_id, 1, pos, 'dataset', source_table, regexp_extract(source_table, '[^.]*$'), contains_description,
         CASE WHEN coalesce(layer, '') <> '' THEN [layer] ELSE [] END, 'source', source_kind, NULL, NULL, NULL
  FROM {{described_sources}}
  UNION ALL
  SELECT run_id, 2, pos, 'file', relative_path, regexp_extract(relative_path, '[^/]*$'), NULL, [], 'evidence', NULL,
         {CATEGORY}, size_bytes, storage_path
  FROM {{stored_files}} WHERE relative_path <> '')
QUALIFY row_number() OVER (PARTITION BY run_id, asset_type, qualified_name ORDER BY rank, pos) = 1"""


def _assets(lab: Lab) -> DataFrame:
    return bundle.assets(lab["app_runs"], lab["described_sources"], lab["stored_files"], lab["asset_contracts"])


@query("asset_inventory", "SELECT * REPLACE (array_to_string(tags, ', ') AS tags) FROM {assets}")
def asset_inventory(lab: Lab) -> DataFrame:
    return _assets(lab).withColumn("tags", F.array_join("tags", ", "))


@query(
    "asset_columns",
    """
SELECT t.run_id, r.target_table AS qualified_name, t.pos AS position, t.field_name, t.origin
FROM {run_transformations} t JOIN {app_runs} r ON r.run_id = t.run_id WHERE coalesce(r.target_table, '') <> ''""",
)
def asset_columns(lab: Lab) -> DataFrame:
    fields = lab["run_transformations"].select("run_id", F.col("pos").alias("position"), "field_name", "origin")
    return bundle.asset_columns(_assets(lab), fields)


@query(
    "registry_overlay",
    f"""
SELECT run_id, asset_type, qualified_name, display_name, role, source_kind FROM {{assets}}
WHERE NOT (asset_type = 'dataset' AND role = 'source')
   OR run_id NOT IN (SELECT run_id FROM {{registry_base}} WHERE {READY})
UNION ALL
SELECT run_id, 'dataset', source_table, source_object_name, 'source', coalesce(nullif(source_kind, ''), 'table')
FROM {{registry_base}} WHERE {READY}""",
)
def registry_overlay(lab: Lab) -> DataFrame:
    return registry.overlay_assets(_assets(lab), registry.ready_rows(lab["registry_base"]))


SPEC = bundle.SPEC
AT = "2001-08-02T00:00:00Z"


def sql_dataset(x: str) -> str:
    dotted = f"contains({x}, '.')"
    return (
        f"struct_pack(namespace := CASE WHEN {dotted} THEN regexp_extract({x}, '^(.*)\\.([^.]*)$', 1) ELSE 'default' END, "
        f"name := CASE WHEN {dotted} THEN regexp_extract({x}, '^(.*)\\.([^.]*)$', 2) ELSE {x} END)"
    )


CHECKS["event_items"] = f"""
SELECT run_id, module_key, 'input' AS part, pos AS position, {sql_dataset('source_table')} AS dataset, NULL AS target
FROM {{run_module_sources}}
UNION ALL
SELECT run_id, module_key, 'target', min(id), NULL, target_node FROM {{run_relations}} GROUP BY run_id, module_key, target_node"""

CHECKS["event_heads"] = f"""
SELECT m.run_id, m.module_key, m.module_name, m.sql_file_name, m.resolved_sql, [{sql_dataset('m.target_table')}] AS outputs
FROM {{run_modules}} m"""

FACETS = f"""struct_pack(
  documentation := struct_pack(_producer := 'ledgerloom', "_schemaURL" := '{SPEC}DocumentationJobFacet.json', description := e.module_name),
  sql := struct_pack(_producer := 'ledgerloom', "_schemaURL" := '{SPEC}SQLJobFacet.json', query := e.resolved_sql),
  module := struct_pack(module_name := e.module_name, sql_file_name := e.sql_file_name))"""
HEAD = f"""eventType := 'COMPLETE', eventTime := '{AT}', producer := 'ledgerloom',
  job := struct_pack(namespace := 'cuentas', name := e.module_key)"""


def _events(lab: Lab) -> DataFrame:
    return bundle.lineage_events(
        lab["run_modules"], lab["run_module_sources"], lab["run_relations"], AT, "cuentas"
    )


@query(
    "lineage_events",
    f"""
SELECT run_id, module_key, 'event' AS part, CAST(0 AS BIGINT) AS position, CAST(to_json(struct_pack({HEAD},
  run := struct_pack("runId" := run_id || '::' || module_key), outputs := outputs, facets := {FACETS})) AS VARCHAR) AS body
FROM {{event_heads}} e
UNION ALL
SELECT run_id, module_key, part, position, CASE part WHEN 'input' THEN CAST(to_json(dataset) AS VARCHAR) ELSE target END
FROM {{event_items}}""",
)
def lineage_events(lab: Lab) -> DataFrame:
    return bundle.event_json(_events(lab))


def sql_slug(x: str, default: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower(trim({x})), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+', '-', 'g'), '-'), ''), '{default}')"


CHECKS["product_ids"] = f"""
SELECT *, 'ledgerloom' AS producer, '/dataproducts/' || product_id AS link FROM (
  SELECT run_id, {sql_slug("coalesce(target_table, product_name)", 'data_product')} AS product_id,
         product_name AS product_label, target_table, {sql_slug('sql_file_name', 'data_product')} AS contract_id,
         sql_file_name || '.odcs.yaml' AS contract_label
  FROM {{app_runs}})"""

CATALOG_FACET = """struct_pack(catalog := struct_pack(_producer := k.producer, "dataProductId" := k.product_id,
  "dataProductName" := k.product_label, "dataProductHref" := k.link, "outputPortId" := k.product_id || '-port',
  "outputPortName" := coalesce(k.target_table, k.product_id),
  "outputPortHref" := k.link || '/outputports/' || k.product_id || '-port', "dataContractId" := k.contract_id,
  "dataContractName" := k.contract_label, "dataContractHref" := '/datacontracts/' || k.contract_id))"""


@query(
    "lineage_events_enriched",
    f"""
SELECT e.run_id, e.module_key, 'event' AS part, CAST(0 AS BIGINT) AS position, CAST(to_json(struct_pack({HEAD},
  run := struct_pack("runId" := e.run_id || '::' || e.module_key, facets := struct_pack(catalog := struct_pack(
    _producer := k.producer, "dataProductId" := k.product_id, "outputPortId" := k.product_id || '-port'))),
  outputs := list_transform(e.outputs, lambda d : struct_pack(namespace := d.namespace, name := d.name, facets := {CATALOG_FACET})),
  facets := {FACETS})) AS VARCHAR) AS body
FROM {{event_heads}} e JOIN {{product_ids}} k ON k.run_id = e.run_id
UNION ALL
SELECT i.run_id, i.module_key, part, position, CASE part WHEN 'input' THEN
  CAST(to_json(struct_pack(namespace := i.dataset.namespace, name := i.dataset.name, facets := {CATALOG_FACET})) AS VARCHAR)
  ELSE target END
FROM {{event_items}} i JOIN {{product_ids}} k ON k.run_id = i.run_id""",
)
def lineage_events_enriched(lab: Lab) -> DataFrame:
    named = lab["app_runs"].withColumn("contract_file", F.concat("sql_file_name", F.lit(".odcs.yaml")))
    return bundle.event_json(bundle.enriched_events(_events(lab), bundle.product_keys(named)))


@query(
    "dataproduct_summary",
    """
SELECT r.run_id, coalesce(c.contract_product, r.product_name) AS name, r.target_table,
       regexp_extract(r.target_table, '[^.]*$') AS schema_name, r.target_table AS schema_physical_name,
       c.domain, coalesce(c.domain, '') AS tags,
       CASE WHEN lower(c.domain) = 'kafka' THEN 'Kafka' ELSE 'Dataset' END AS port_type,
       CASE lower(coalesce(c.contract_status, r.status)) WHEN 'proposed' THEN 'proposed' ELSE 'active' END AS status,
       concat_ws(chr(10) || chr(10), CASE WHEN trim(c.purpose) <> '' THEN 'Purpose: ' || trim(c.purpose) END,
                 CASE WHEN trim(c.usage) <> '' THEN 'Usage: ' || trim(c.usage) END,
                 CASE WHEN trim(c.limitations) <> '' THEN 'Limitations: ' || trim(c.limitations) END) AS description,
       CAST(coalesce(c.contract_fields, f.n, 0) AS BIGINT) AS field_count, coalesce(s.n, 0) AS source_count,
       coalesce(s.named, 0) AS distinct_source_count
FROM {app_runs} r LEFT JOIN {run_contracts} c ON c.run_id = r.run_id
LEFT JOIN (SELECT run_id, count(*) AS n, count(DISTINCT source_table) AS named FROM {run_module_sources} GROUP BY run_id) s
  ON s.run_id = r.run_id
LEFT JOIN (SELECT run_id, count(*) AS n FROM {run_transformations} GROUP BY run_id) f ON f.run_id = r.run_id""",
)
def dataproduct_summary(lab: Lab) -> DataFrame:
    rows = bundle.product_summary(
        lab["app_runs"], lab["run_contracts"], lab["run_module_sources"], lab["run_transformations"]
    )
    return rows.withColumn("tags", F.array_join("tags", "; "))


@query("dataproduct_sources", "SELECT DISTINCT run_id, source_table FROM {run_module_sources}")
def dataproduct_sources(lab: Lab) -> DataFrame:
    return bundle.product_sources(lab["run_module_sources"])


@query(
    "import_plan",
    """
SELECT r.run_id, TRUE AS create_or_update_data_product, coalesce(a.odcs_yaml, '') <> '' AS publish_datacontract,
       (SELECT count(*) FROM {assets} x WHERE x.run_id = r.run_id AND role = 'target') AS target_dataset_count,
       (SELECT count(*) FROM {assets} x WHERE x.run_id = r.run_id AND role = 'source') AS source_dataset_count,
       (SELECT count(*) FROM {run_relations} x WHERE x.run_id = r.run_id) AS lineage_relation_count,
       (SELECT count(*) FROM {run_modules} x WHERE x.run_id = r.run_id) AS lineage_event_count,
       (SELECT count(*) FROM {assets} x WHERE x.run_id = r.run_id AND role = 'evidence') AS evidence_file_count,
       (SELECT count(*) FROM {run_findings} x WHERE x.run_id = r.run_id) AS quality_finding_count
FROM {app_runs} r LEFT JOIN {run_analysis} a ON a.run_id = r.run_id""",
)
def import_plan(lab: Lab) -> DataFrame:
    texts = lab["run_analysis"].select("run_id", F.col("odcs_yaml").alias("contract_yaml"))
    return bundle.import_plan(
        lab["app_runs"].join(texts, "run_id", "left"),
        _assets(lab),
        lab["run_relations"],
        lab["run_modules"],
        lab["run_findings"],
    )


# ---------------------------------------------------------------- lineage

GROUP_SQL = (
    "CASE WHEN contains({x}, '::') AND {kind} = 'process' THEN 'process' "
    "WHEN regexp_matches(lower({x}), '^rd_baz_bdclientes[.]|(^|[.])rd_[^.]*$') THEN 'raw' "
    "WHEN regexp_matches(lower({x}), '^cd_baz_bdclientes[.]|(^|[.])cd_[^.]*$') THEN 'cd' "
    "WHEN regexp_matches(lower({x}), '^(ws_ec_)?cu_baz_bdclientes[.]|(^|[.])cu_[^.]*$') THEN 'cu' "
    "WHEN contains({x}, '::') THEN 'process' ELSE 'other' END"
)

CHECKS["named_tables"] = """
SELECT run_id, module_key, pos, i, base FROM (
  SELECT run_id, module_key, pos, i, trim(split_part(trim(raw), ' AS ', 1)) AS base FROM (
    SELECT run_id, module_key, pos, unnest(parts) AS raw, generate_subscripts(parts, 1) AS i
    FROM (SELECT *, string_split(split_part(source_table, '(subconsulta', 1), ',') AS parts FROM {run_module_sources})))
WHERE base <> '' AND NOT starts_with(base, '_')"""

CHECKS["placed"] = """
SELECT s.run_id, s.module_key, s.pos, s.source_alias, s.source_table, m.target_table,
       s.pos = min(s.pos) OVER (PARTITION BY s.run_id, s.module_key) AS is_first,
       contains(lower(m.resolved_sql), 'union all')
         AND (SELECT count(*) FROM {named_tables} t WHERE t.run_id = s.run_id AND t.module_key = s.module_key AND t.pos = s.pos) > 1
         AS unites
FROM {run_module_sources} s JOIN {run_modules} m ON m.run_id = s.run_id AND m.module_key = s.module_key"""

CHECKS["known_edges"] = """
SELECT p.run_id, p.module_key, t.base AS source_node,
       CASE WHEN p.is_first AND p.unites THEN p.target_table || '::union_all' ELSE p.target_table END AS target_node,
       CASE WHEN p.is_first AND p.unites THEN 'UNION ALL'
            WHEN p.is_first THEN CASE WHEN t.i = min(t.i) OVER (PARTITION BY t.run_id, t.module_key, t.pos)
                                      THEN 'FROM / BASE' ELSE 'SOURCE' END
            ELSE coalesce(upper(j.join_type), 'JOIN') END AS relation_label,
       'table' AS source_kind, CASE WHEN p.is_first AND p.unites THEN 'process' ELSE 'table' END AS target_kind,
       p.is_first AND NOT p.unites AND t.i = min(t.i) OVER (PARTITION BY t.run_id, t.module_key, t.pos) AS is_pivot
FROM {placed} p JOIN {named_tables} t ON t.run_id = p.run_id AND t.module_key = p.module_key AND t.pos = p.pos
LEFT JOIN (SELECT run_id, module_key, lower(source_alias) AS a, arg_max(join_type, pos) AS join_type
           FROM {run_joins} GROUP BY ALL) j
     ON j.run_id = p.run_id AND j.module_key = p.module_key AND j.a = lower(p.source_alias) AND NOT p.is_first
UNION
SELECT run_id, module_key, target_table || '::union_all', target_table, 'FROM / BASE', 'process', 'table', TRUE
FROM {placed} WHERE is_first AND unites
UNION
SELECT run_id, module_key, source_table, target_table, 'FROM / BASE', 'table', 'table', TRUE
FROM {placed} p WHERE is_first AND NOT EXISTS (
  SELECT 1 FROM {named_tables} t WHERE t.run_id = p.run_id AND t.module_key = p.module_key AND t.pos = p.pos)"""

CHECKS["all_edges"] = """
SELECT * FROM {known_edges}
UNION
SELECT f.run_id, f.module_key, f.base, m.target_table, 'LINEAGE', 'table', 'table', FALSE
FROM (SELECT run_id, module_key, regexp_extract(unnest(physical_source_fields), '^(.*)[.][^.]*$', 1) AS base
      FROM {run_transformations}) f
JOIN {run_modules} m ON m.run_id = f.run_id AND m.module_key = f.module_key
WHERE f.base <> m.target_table AND NOT EXISTS (
  SELECT 1 FROM {known_edges} k WHERE k.run_id = f.run_id AND k.module_key = f.module_key AND k.source_node = f.base)"""


@query(
    "flow_edges",
    f"""
SELECT *, {GROUP_SQL.format(x='source_node', kind='source_kind')} AS source_group,
       {GROUP_SQL.format(x='target_node', kind='target_kind')} AS target_group
FROM {{all_edges}}""",
)
def flow_edges(lab: Lab) -> DataFrame:
    return lineage.flow_edges(
        lab["run_modules"], lab["run_module_sources"], lab["run_joins"], lab["run_transformations"]
    )


CHECKS["walk"] = """
WITH RECURSIVE steps AS (
  SELECT l.final_table_name, l.run_id, r.source_node AS node, 1 AS depth
  FROM {latest_ok} l JOIN {run_relations} r ON r.run_id = l.run_id AND r.target_node = l.final_table_name
  UNION
  SELECT s.final_table_name, s.run_id, r.source_node, s.depth + 1
  FROM steps s JOIN {run_relations} r ON r.run_id = s.run_id AND r.target_node = s.node WHERE s.depth < 14)
SELECT final_table_name, run_id, node, CAST(min(depth) AS INT) AS depth FROM steps GROUP BY ALL"""


def _closure(lab: Lab) -> DataFrame:
    return lineage.closure(runs.latest_passing_runs(lab["app_runs"]), lab["run_relations"])


@query("lineage_closure", "SELECT * FROM {walk}")
def lineage_closure(lab: Lab) -> DataFrame:
    return _closure(lab)


@query(
    "lineage_physical_inputs",
    f"""
SELECT DISTINCT final_table_name, run_id, node AS tabla_insumo FROM {{walk}}
WHERE contains(node, '.') AND split_part(node, '.', 1) IN {sql_list(fixed.INPUT_SCHEMAS)}
  AND NOT ends_with(node, '::union_all')""",
)
def lineage_physical_inputs(lab: Lab) -> DataFrame:
    return lineage.physical_inputs(_closure(lab))


@query(
    "column_lineage_explode",
    """
SELECT run_id, module_key, field_name, regexp_extract(f, '^(.*)[.]([^.]*)$', 1) AS base_table,
       regexp_extract(f, '^(.*)[.]([^.]*)$', 2) AS source_column
FROM (SELECT *, unnest(physical_source_fields) AS f FROM {run_transformations})""",
)
def column_lineage_explode(lab: Lab) -> DataFrame:
    return lineage.column_sources(lab["run_transformations"])


@query(
    "lineage_expand",
    """
WITH refs AS (
  SELECT run_id, field_name, split_part(c, '.', 1) AS a, split_part(c, '.', 2) AS col
  FROM (SELECT run_id, field_name, unnest(columns) AS c FROM {field_references}) WHERE contains(c, '.'))
SELECT run_id, field_name, unnest(physical_source_fields) AS physical_field FROM {field_references}
UNION
SELECT r.run_id, r.field_name, k.base_table || '.' || k.source_column
FROM refs r JOIN {alias_columns} k ON k.run_id = r.run_id AND lower(k.alias) = lower(r.a) AND lower(k.column) = lower(r.col)
UNION
SELECT r.run_id, r.field_name, t.table_name || '.' || r.col
FROM refs r JOIN {alias_tables} t ON t.run_id = r.run_id AND lower(t.alias) = lower(r.a)""",
)
def lineage_expand(lab: Lab) -> DataFrame:
    return lineage.expanded_sources(lab["field_references"], lab["alias_columns"], lab["alias_tables"])


@query(
    "source_contributions",
    f"""
SELECT s.run_id, s.module_key, s.source_alias, coalesce(f.field_name, '{fixed.NO_CONTRIBUTION}') AS field_generated
FROM (SELECT DISTINCT run_id, module_key, source_alias FROM {{run_module_sources}}) s
LEFT JOIN (SELECT DISTINCT run_id, module_key, field_name, a
           FROM (SELECT *, unnest(string_split(origin, ' / ')) AS a FROM {{run_transformations}})) f
  ON f.run_id = s.run_id AND f.module_key = s.module_key AND f.a = s.source_alias""",
)
def source_contributions(lab: Lab) -> DataFrame:
    return lineage.contributions(lab["run_module_sources"], lab["run_transformations"])


@query(
    "source_steps",
    """
WITH facts AS (
  SELECT run_id, module_key, arg_min(source_alias, pos) AS a, [2] AS steps FROM {run_module_sources} GROUP BY ALL
  UNION ALL SELECT run_id, module_key, source_alias, [1] FROM {run_module_sources} WHERE source_kind IN ('cte', 'subquery')
  UNION ALL SELECT run_id, module_key, lower(source_alias), [3] FROM {run_joins}
  UNION ALL SELECT run_id, module_key, alias, [1, 4] FROM {lines} WHERE l_linenumber = 4
  UNION ALL SELECT run_id, module_key, alias, [4] FROM {lines} WHERE l_linenumber = 3
  UNION ALL SELECT run_id, module_key, split_part(origin, ' / ', 1), [5, 6] FROM {run_transformations} WHERE pos >= 20000000000000),
marks AS (SELECT DISTINCT run_id, module_key, a, unnest(steps) AS step FROM facts)
SELECT s.run_id, s.module_key, s.source_alias,
       coalesce(string_agg('Paso ' || CAST(m.step AS STRING), ', ' ORDER BY m.step), '') AS used_in_steps
FROM (SELECT DISTINCT run_id, module_key, source_alias FROM {run_module_sources}) s
LEFT JOIN marks m ON m.run_id = s.run_id AND m.module_key = s.module_key AND m.a = s.source_alias
GROUP BY s.run_id, s.module_key, s.source_alias""",
)
def source_steps(lab: Lab) -> DataFrame:
    sources, lines = lab["run_module_sources"], lab["lines"].withColumnRenamed("alias", "source_alias")
    first = sources.groupBy(*lineage.MODULE).agg(F.min_by("source_alias", "pos").alias("source_alias"))
    projected = lab["run_transformations"].where("pos >= 20000000000000").withColumn(
        "source_alias", F.split_part("origin", F.lit(" / "), F.lit(1))
    )
    facts = {
        "base": (first, [2]),
        "prepared": (sources.where(F.col("source_kind").isin("cte", "subquery")), [1]),
        "joined": (lab["run_joins"].withColumn("source_alias", F.lower("source_alias")), [3]),
        "filtered inside": (lines.where("l_linenumber = 4"), [1, 4]),
        "filtered": (lines.where("l_linenumber = 3"), [4]),
        "projected": (projected, [5, 6]),
    }
    rows = lineage.steps_of_sources(sources, facts)
    return rows.withColumn("used_in_steps", F.array_join("used_in_steps", ", "))


@query(
    "traceability_matrix",
    """
SELECT f.run_id, f.module_key, f.field_name, CASE WHEN has_subquery THEN '●' ELSE '' END AS p1,
       CASE WHEN has_source THEN '●' ELSE '' END AS p2,
       CASE WHEN EXISTS (SELECT 1 FROM {run_joins} j WHERE j.run_id = f.run_id AND j.module_key = f.module_key)
            THEN '●' ELSE '' END AS p3,
       CASE WHEN EXISTS (SELECT 1 FROM {lines} l WHERE l.run_id = f.run_id AND l.module_key = f.module_key AND l.l_linenumber = 4)
            THEN '●' ELSE '' END AS p4, '●' AS p5, '●' AS p6, '' AS p7
FROM {field_facts} f""",
)
def traceability_matrix(lab: Lab) -> DataFrame:
    return lineage.traceability(lab["field_facts"], lab["run_joins"], lab["lines"].where("l_linenumber = 4"))


def _sql_subtype() -> str:
    labels = [
        f"CASE WHEN list_has_any(functions, {list(names)}){' OR has_aggregate' if label == 'Agregacion' else ''} THEN '{label}' END"
        for label, names in fixed.SUBTYPES
    ]
    return f"coalesce(nullif(concat_ws(' + ', {', '.join(labels)}, CASE WHEN is_constant THEN 'Constante' END), ''), 'Calculo')"


@query(
    "transform_subtype",
    f"""
SELECT run_id, field_name, CASE WHEN lower(renamed_from) = lower(field_name) THEN 'D' ELSE 'T' END AS field_type,
       CASE WHEN lower(renamed_from) = lower(field_name) THEN '—' WHEN renamed_from IS NOT NULL THEN 'Renombre'
            ELSE {_sql_subtype()} END AS subtype
FROM {{field_facts}}""",
)
def transform_subtype(lab: Lab) -> DataFrame:
    return lineage.classified(lab["field_facts"])


@query(
    "rule_numbering",
    """
SELECT run_id, 'RN-' || CASE WHEN n < 10 THEN '0' ELSE '' END || CAST(n AS STRING) AS rule_id, description, applies_in
FROM (
  SELECT run_id, 'regla ' || alias AS description,
         CASE WHEN l_linenumber <= 2 THEN 'Paso 4' WHEN l_linenumber <= 4 THEN 'Paso 5' ELSE 'Paso 1' END AS applies_in,
         row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_linenumber <= 4 THEN 2
                                                              ELSE 1 END, pos) AS n
  FROM (SELECT * REPLACE (CASE WHEN l_orderkey % 50 <> 0 THEN run_id END AS run_id,
                          CAST(pos AS HUGEINT) * 10000000 + l_orderkey AS pos) FROM {lines}))""",
)
def rule_numbering(lab: Lab) -> DataFrame:
    # Some rules belong to no run; they are numbered among themselves.
    rules = lab["lines"].select(
        F.when(F.col("l_orderkey") % 50 != 0, F.col("run_id")).alias("run_id"),
        (F.col("pos").cast("decimal(38,0)") * 10000000 + F.col("l_orderkey")).alias("pos"),
        "l_linenumber",
        F.concat(F.lit("regla "), "alias").alias("description"),
    )
    return lineage.numbered_rules(
        rules.where("l_linenumber <= 2").withColumn("step", F.lit("Paso 4")),
        rules.where("l_linenumber >= 5"),
        rules.where("l_linenumber IN (3, 4)"),
    )


@query(
    "module_sequence",
    """
WITH RECURSIVE chain AS (
  SELECT DISTINCT run_id, module_id, 0 AS level FROM {declared_modules}
  UNION
  SELECT m.run_id, m.module_id, c.level + 1 FROM chain c
  JOIN {declared_modules} m ON m.run_id = c.run_id AND list_contains(m.depends_on, c.module_id)),
depth AS (SELECT run_id, module_id, max(level) AS level FROM chain GROUP BY ALL)
SELECT m.run_id, m.sequence, m.module_id, array_to_string(m.depends_on, ', ') AS depends_on,
       replace(array_to_string(m.output_tables, ', '), chr(36) || '{{esquema_cu}}', 'ws_cu') AS output_tables,
       CASE WHEN coalesce(m.is_principal, FALSE) OR list_contains(m.output_tables, m.final_table) THEN 'PRINCIPAL' ELSE 'STEP' END
         AS document_role,
       CAST(d.level AS INT) AS level
FROM {declared_modules} m JOIN depth d ON d.run_id = m.run_id AND d.module_id = m.module_id""",
)
def module_sequence(lab: Lab) -> DataFrame:
    return lineage.module_sequence(lab["declared_modules"], {"${esquema_cu}": "ws_cu"}).drop("cycle")


@query(
    "module_cycles",
    """
WITH RECURSIVE needs AS (
  SELECT DISTINCT n.run_id, n.u, n.v FROM (SELECT run_id, module_id AS u, unnest(depends_on) AS v FROM {looped_modules}) n
  JOIN {looped_modules} m ON m.run_id = n.run_id AND m.module_id = n.v),
reach AS (
  SELECT run_id, u, v FROM needs
  UNION
  SELECT r.run_id, r.u, n.v FROM reach r JOIN needs n ON n.run_id = r.run_id AND n.u = r.v),
rings AS (
  SELECT a.run_id, a.u, min(a.v) AS ring FROM reach a JOIN reach b ON b.run_id = a.run_id AND b.u = a.v AND b.v = a.u
  GROUP BY ALL),
ones AS (
  SELECT DISTINCT m.run_id, m.module_id, r.ring, coalesce(r.ring, m.module_id) AS one
  FROM {looped_modules} m LEFT JOIN rings r ON r.run_id = m.run_id AND r.u = m.module_id),
below AS (
  SELECT DISTINCT n.run_id, a.one AS u, b.one AS v FROM needs n
  JOIN ones a ON a.run_id = n.run_id AND a.module_id = n.u JOIN ones b ON b.run_id = n.run_id AND b.module_id = n.v
  WHERE a.one <> b.one),
chain AS (
  SELECT DISTINCT run_id, one, 0 AS level FROM ones
  UNION
  SELECT c.run_id, b.u, c.level + 1 FROM chain c JOIN below b ON b.run_id = c.run_id AND b.v = c.one),
depth AS (SELECT run_id, one, max(level) AS level FROM chain GROUP BY ALL)
SELECT o.run_id, o.module_id, CAST(d.level AS INT) AS level, o.ring AS cycle
FROM {looped_modules} m JOIN ones o ON o.run_id = m.run_id AND o.module_id = m.module_id
JOIN depth d ON d.run_id = o.run_id AND d.one = o.one""",
)
def module_cycles(lab: Lab) -> DataFrame:
    """Levels of modules some of which wait for each other in a circle."""
    found = lineage.module_sequence(lab["looped_modules"], {})
    return found.select("run_id", "module_id", "level", "cycle")
