"""Bindings of the catalogue tables: runs from events, their details from line items."""

from __future__ import annotations

from suite.lab import BINDINGS


def run_id(key: str) -> str:
    return f"'run-' || lpad(CAST({key} AS STRING), 10, '0')"


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


SCHEMA = (
    "CASE user_id % 5 WHEN 0 THEN 'cd_baz_bdclientes' WHEN 1 THEN 'rd_baz_bdclientes' "
    "WHEN 2 THEN 'rd_baz_bdsopoperlog' WHEN 3 THEN 'demo' ELSE 'cd_baz_bdclientes' END"
)

BINDINGS["app_runs"] = lambda d: f"""
SELECT {run_id('event_id')} AS run_id, ts AS created_at, 'Producto ' || event_type AS product_name,
       event_type || '_' || {text('user_id')} || '.sql' AS sql_file_name,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE {SCHEMA} || '.cd_t' || {text('user_id')} END AS final_table_name,
       CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN upper({SCHEMA} || '.cd_t' || {text('user_id')})
            ELSE {SCHEMA} || '.cd_t' || {text('user_id')} END AS target_table,
       event_type <> 'error' AS audit_passed,
       CASE event_type WHEN 'error' THEN 'warning' ELSE 'completed' END AS status,
       '{{{{"sources": ' || {text(d.field('props', 'k'))} || ', "transformations": ' ||
         {text(d.field('props', 'k') + ' * 2')} || '}}}}' AS stats,
       CASE WHEN event_id % 3 = 0 THEN '{{{{}}}}' ELSE '{{{{"datacontract_yaml": "' || {run_id('event_id')} ||
         '/contracts/cd_t' || {text('user_id')} || '.odcs.yaml"}}}}' END AS storage_objects
FROM {{events}}"""

BINDINGS["run_analysis"] = lambda d: f"""
SELECT {run_id('event_id')} AS run_id,
       CASE WHEN event_id % 4 = 0 THEN 'id: t' || {text('user_id')} || chr(10) || 'status: ' || event_type
            WHEN event_id % 4 = 1 THEN '' END AS odcs_yaml
FROM {{events}}"""

BINDINGS["stored_objects"] = lambda d: f"""
SELECT {run_id('event_id')} || '/contracts/cd_t' || {text('user_id')} || '.odcs.yaml' AS path,
       'stored: ' || props AS text
FROM {{events}} WHERE event_type <> 'view'"""

BINDINGS["run_control"] = lambda d: f"""
SELECT {run_id('event_id')} AS run_id, value > 20 AS include_in_catalog,
       CASE event_type WHEN 'error' THEN 'excluded' WHEN 'purchase' THEN 'approved' ELSE 'pending' END AS review_status,
       {d.strings("'revisar ' || event_type", "'avisar'")} AS complementary_actions,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'nota ' || event_type END AS notes,
       CASE WHEN value > 50 THEN 'planned' ELSE 'idle' END AS last_import_status,
       CASE WHEN value > 50 THEN ts + INTERVAL 1 DAY END AS last_operation_at,
       CAST(NULL AS TIMESTAMP{'_NTZ' if d.name == 'spark' else ''}) AS last_imported_at,
       '{{{{}}}}' AS last_import_result, ts AS created_at, ts AS updated_at
FROM {{events}} WHERE event_type IN ('purchase', 'error', 'signup')"""

BINDINGS["control_changes"] = lambda d: f"""
SELECT {run_id('event_id')} AS run_id, CASE WHEN value > 30 THEN TRUE END AS include_in_catalog,
       CASE WHEN event_id % 2 = 0 THEN 'approved' END AS review_status,
       CASE WHEN event_id % 5 = 0 THEN 'cambio ' || {text('user_id')} END AS notes
FROM {{events}} WHERE event_type IN ('purchase', 'click')"""

BINDINGS["operations"] = lambda d: f"""
SELECT {run_id('l_orderkey')} AS run_id, l_shipdate AS operation_at,
       (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey AS operation_id,
       CASE l_returnflag WHEN 'A' THEN 'executed' WHEN 'N' THEN 'planned' ELSE 'failed' END AS status,
       '{{{{"linea": ' || {text('l_linenumber')} || '}}}}' AS result
FROM {{lineitem}}"""

# One row per order line: the shape most catalogue details are made from. Positions are unique per run.
BINDINGS["lines"] = lambda d: f"""
SELECT l_orderkey, l_linenumber, l_partkey, {run_id('l_orderkey')} AS run_id,
       CASE WHEN l_linenumber <= 3 THEN 'paso_01' ELSE 'paso_02' END AS module_key,
       (CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 1000000 + l_suppkey AS pos,
       't' || {text('l_linenumber')} || '_' || {text('l_partkey')} || '_' || {text('l_suppkey')} AS alias,
       {text('l_partkey')} AS p
FROM {{lineitem}}"""

BINDINGS["analysis_items"] = lambda d: f"""
SELECT {run_id('l_orderkey')} AS run_id,
       CASE WHEN l_linenumber <= 2 THEN 'source' WHEN l_linenumber = 3 THEN 'join' WHEN l_linenumber = 4 THEN 'filter'
            WHEN l_linenumber <= 6 THEN 'transformation' ELSE 'rule' END AS kind,
       CASE WHEN l_linenumber IN (5, 6) THEN CASE l_linestatus WHEN 'O' THEN 'D' ELSE 'T' END END AS field_type
FROM {{lineitem}}"""

BINDINGS["run_modules"] = lambda d: """
SELECT run_id, module_key,
       'Modulo ' || module_key AS module_name, module_key || '.sql' AS sql_file_name,
       CASE module_key WHEN 'paso_01' THEN 'cu_baz_bdclientes.cu_m' ELSE 'cd_baz_bdclientes.cd_m' END ||
         CAST(l_orderkey AS STRING) AS target_table,
       CASE WHEN l_orderkey % 3 = 0 THEN 'select a from x Union All select a from y' ELSE 'select a from x' END
         AS resolved_sql
FROM {lines} GROUP BY run_id, module_key, l_orderkey"""

BINDINGS["run_module_sources"] = lambda d: """
SELECT run_id, module_key, pos, alias AS source_alias,
       CASE l_partkey % 7 WHEN 0 THEN 'rd_baz_bdclientes.rd_p' || p || ' AS ' || alias
            WHEN 1 THEN 'cu_baz_bdclientes.cu_p' || p
            WHEN 2 THEN 'rd_baz_bdclientes.rd_p' || p || ' AS a, ws_ec_cu_baz_bdclientes.q' || p || ' AS b (subconsulta mix)'
            WHEN 3 THEN 'CTE _tmp_' || p || ' (derivada de raw.p' || p || ')'
            WHEN 4 THEN '_logica_' || p || ' AS l'
            WHEN 5 THEN 'stg_carga.t' || p ELSE 'cd_baz_bdclientes.cd_p' || p END AS source_table,
       CASE l_partkey % 7 WHEN 2 THEN 'subquery' WHEN 3 THEN 'cte' WHEN 5 THEN 'view' WHEN 6 THEN '' ELSE 'table' END
         AS source_kind
FROM {lines}"""

BINDINGS["run_joins"] = lambda d: """
SELECT run_id, module_key, pos, upper(alias) AS source_alias,
       CASE l_partkey % 2 WHEN 0 THEN 'left' ELSE 'Inner' END AS join_type
FROM {lines} WHERE l_linenumber IN (2, 3, 5, 6)
UNION ALL SELECT run_id, module_key, pos + 1, alias, 'full' FROM {lines} WHERE l_linenumber IN (3, 6) AND l_partkey % 3 = 0"""

BINDINGS["run_transformations"] = lambda d: f"""
SELECT run_id, module_key, pos, 'campo_' || alias AS field_name,
       alias || CASE WHEN l_partkey % 4 = 0 THEN ' / ajeno' ELSE '' END AS origin,
       {d.strings("'rd_baz_bdclientes.rd_p' || p || '.c' || CAST(l_linenumber AS STRING)",
                  "'cu_lin.t' || CAST(l_partkey % 10 AS STRING) || '.k'")} AS physical_source_fields
FROM {{lines}}"""

NODE = (
    "CASE l_partkey % 5 WHEN 0 THEN 'rd_baz_bdclientes.rd_p' WHEN 1 THEN 'tmp_baz_bdclientes.p' "
    "WHEN 2 THEN 'stg_carga.p' WHEN 3 THEN 'cd_baz_bdclientes.cd_p' ELSE 'suelta_' END || p || "
    "CASE WHEN l_partkey % 15 = 0 THEN '::union_all' ELSE '' END"
)
STEP = "'cu_baz_bdclientes.paso_' || CAST({} AS STRING)"

BINDINGS["run_relations"] = lambda d: f"""
SELECT run_id, module_key, pos * 10 + edge AS id,
       CASE edge WHEN 0 THEN {NODE} WHEN 1 THEN {STEP.format('l_linenumber')} ELSE final_table_name END AS source_node,
       CASE WHEN edge <> 1 THEN {STEP.format('l_linenumber')} WHEN l_linenumber = 1 THEN final_table_name
            ELSE {STEP.format('CAST(floor(l_linenumber / 2) AS INT)')} END AS target_node,
       CASE edge WHEN 0 THEN 'FROM / BASE' WHEN 1 THEN 'LEFT' ELSE 'LINEAGE' END AS relation_label,
       CASE WHEN edge = 0 AND l_partkey % 15 = 0 THEN 'process' ELSE 'table' END AS source_kind
FROM (SELECT l.run_id, l.module_key, l.pos, l.p, l.l_linenumber, l.l_partkey, r.final_table_name, edge
      FROM {{lines}} l LEFT JOIN {{app_runs}} r ON r.run_id = l.run_id {d.each('edge', 0, 1, 2)}) AS e
WHERE edge = 0 OR (edge = 1 AND final_table_name IS NOT NULL)
   OR (edge = 2 AND final_table_name IS NOT NULL AND l_linenumber = 6)"""

BINDINGS["run_files"] = lambda d: f"""
SELECT {run_id('page_id')} AS run_id, page_id AS pos,
       CASE page_id % 5 WHEN 0 THEN 'sql/' WHEN 1 THEN 'Metadata/' WHEN 2 THEN 'templates/' WHEN 3 THEN '' ELSE 'x/' END ||
       CASE WHEN page_id % 5 = 3 AND page_id % 2 = 1 THEN 'config.yml'
            ELSE substr(url, CAST(instr(url, '//') AS INT) + 2) END AS relative_path,
       CAST(length(html) AS BIGINT) AS size_bytes
FROM {{pages}}"""

BINDINGS["schema_rows"] = lambda d: f"""
SELECT s_suppkey AS fila, CASE s_suppkey WHEN 0 THEN ' rd_baz_bdclientes' WHEN 1 THEN 'stg_carga' WHEN 2 THEN 'cd_baz_bdclientes '
            WHEN 3 THEN 'cu_baz_bdclientes' WHEN 4 THEN ' ' WHEN 9 THEN 'stg_carga'
            ELSE CASE s_suppkey % 4 WHEN 0 THEN 'rd_' WHEN 1 THEN 'STG_' WHEN 2 THEN 'tmp_' ELSE 'x_' END ||
                 {text('s_suppkey')} || CASE WHEN s_suppkey % 9 = 0 THEN '_tmp' ELSE '' END END AS esquema,
       CASE WHEN s_suppkey % 3 = 0 THEN '  ' ELSE s_name END AS descripcion,
       CASE WHEN s_nationkey < 4 THEN 'raw' WHEN s_nationkey < 8 THEN 'Curado' WHEN s_nationkey < 12 THEN ' CRYSTAL '
            WHEN s_nationkey < 15 THEN 'TEMPORAL' WHEN s_nationkey < 20 THEN NULL ELSE 'algo-raro' END AS proposito
FROM {{supplier}}"""

BINDINGS["registry_base"] = lambda d: f"""
SELECT l.run_id, r.target_table, 'rd_baz_bdclientes.rd_p' || l.p AS source_table,
       'rd_baz_bdclientes' AS source_schema, 'rd_p' || l.p AS source_object_name,
       CASE l.l_partkey % 4 WHEN 0 THEN 'RAW' WHEN 1 THEN 'raw' WHEN 2 THEN 'OTRO' END AS source_schema_type,
       CASE l.l_partkey % 3 WHEN 0 THEN '' ELSE 'table' END AS source_kind,
       l.l_partkey % 5 = 0 AS is_temporary, l.l_partkey % 5 <> 0 AS include_in_catalog,
       CASE l.l_partkey % 6 WHEN 0 THEN 'approved' WHEN 1 THEN 'excluded' WHEN 2 THEN 'raro' ELSE 'candidate' END
         AS review_status,
       'manual' AS decision_source, r.created_at AS loaded_at
FROM {{lines}} l JOIN {{app_runs}} r ON r.run_id = l.run_id
WHERE r.target_table IS NOT NULL
GROUP BY l.run_id, r.target_table, l.p, l.l_partkey, r.created_at"""

BINDINGS["run_contracts"] = lambda d: f"""
SELECT {run_id('event_id')} AS run_id, CASE WHEN value > 40 THEN 'Cuentas ' || {text('user_id')} END AS contract_product,
       CASE event_type WHEN 'view' THEN 'Proposed' WHEN 'click' THEN 'done' END AS contract_status,
       CASE WHEN event_id % 13 = 0 THEN 'Kafka' ELSE 'captacion' END AS domain, CASE WHEN event_id % 2 = 0 THEN ' Para ' || event_type END AS purpose,
       CASE WHEN event_id % 3 = 0 THEN 'Diario' ELSE '  ' END AS usage,
       CASE WHEN event_id % 5 = 0 THEN 'Sin historia' END AS limitations,
       CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS INT) END AS contract_fields
FROM {{events}} WHERE event_type <> 'signup'"""

BINDINGS["run_findings"] = lambda d: f"""
SELECT {run_id('doc_id')} AS run_id, 'error' AS severity, 'calidad' AS message FROM {{labels}} WHERE quality = 0
UNION ALL SELECT {run_id('doc_id')}, 'warning', 'toxicidad' FROM {{labels}} WHERE toxic = 1"""

BINDINGS["field_references"] = lambda d: f"""
SELECT run_id, 'campo_' || alias AS field_name, {d.strings("'rd_lin.t' || p || '.k'")} AS physical_source_fields,
       {d.strings("upper(alias) || '.C' || CAST(l_partkey % 4 AS STRING)", "'suelta'")} AS columns
FROM {{lines}}"""

BINDINGS["alias_columns"] = lambda d: """
SELECT run_id, alias, 'c' || CAST(l_partkey % 3 AS STRING) AS column, 'rd_lin.t' || p AS base_table,
       'k' || CAST(l_linenumber AS STRING) AS source_column
FROM {lines} WHERE l_linenumber <= 5"""

BINDINGS["alias_tables"] = lambda d: """
SELECT run_id, alias, 'cu_lin.t' || p AS table_name FROM {lines} WHERE l_linenumber >= 3"""

BINDINGS["field_facts"] = lambda d: f"""
SELECT run_id, module_key, pos, 'campo_' || alias AS field_name, l_partkey % 4 = 0 AS has_subquery,
       l_partkey % 3 <> 0 AS has_source,
       CASE l_partkey % 7 WHEN 0 THEN {d.strings("'CAST'", "'TRIM'")} WHEN 1 THEN {d.strings("'COALESCE'")}
            WHEN 2 THEN {d.strings("'CASE'", "'SUM'", "'TRY_CAST'")} WHEN 3 THEN {d.strings("'CONCAT'")}
            ELSE {d.no_strings} END AS functions, l_partkey % 21 = 6 AS has_aggregate,
       CASE WHEN l_partkey % 7 = 4 THEN 'Campo_' || alias WHEN l_partkey % 7 = 5 THEN 'otro' END AS renamed_from,
       l_partkey % 14 IN (0, 6) AS is_constant
FROM {{lines}}"""

BINDINGS["declared_modules"] = lambda d: f"""
SELECT run_id, pos AS sequence, 'm' || {text('l_linenumber')} AS module_id,
       CASE WHEN l_linenumber = 1 THEN {d.no_strings}
            ELSE {d.strings("'m' || CAST(CAST(floor(l_linenumber / 2) AS INT) AS STRING)")} END AS depends_on,
       {d.strings("chr(36) || '{{{{esquema_cu}}}}.cu_m' || CAST(l_partkey % 40 AS STRING)", "'demo.fijo'")} AS output_tables,
       CASE WHEN l_partkey % 13 = 0 THEN TRUE END AS is_principal,
       chr(36) || '{{{{esquema_cu}}}}.cu_m7' AS final_table
FROM {{lines}}"""

# In every third order the first module waits for the fifth, which waits for it by way of the second.
BINDINGS["looped_modules"] = lambda d: f"""
SELECT run_id, pos AS sequence, 'm' || {text('l_linenumber')} AS module_id,
       CASE WHEN l_linenumber > 1 THEN {d.strings("'m' || CAST(CAST(floor(l_linenumber / 2) AS INT) AS STRING)")}
            WHEN l_orderkey % 3 = 0 THEN {d.strings("'m5'")} ELSE {d.no_strings} END AS depends_on,
       {d.strings("'demo.fijo'")} AS output_tables, FALSE AS is_principal, 'demo.fijo' AS final_table
FROM {{lines}}"""

# What contracts, sources and files say about the assets of a run.
BINDINGS["asset_contracts"] = lambda d: f"""
SELECT run_id, CASE WHEN n % 3 = 0 THEN 'Tabla ' || {text('n')} END AS schema_name,
       CASE WHEN n % 4 <> 1 THEN 'Contrato de ' || run_id END AS schema_description,
       CASE WHEN n % 2 = 0 THEN {d.strings("'captacion'", "'nivel ' || CAST(n % 5 AS STRING)")}
            ELSE {d.no_strings} END AS tags
FROM (SELECT run_id, CAST(length(product_name) + length(sql_file_name) AS BIGINT) AS n FROM {{app_runs}}) AS r
WHERE n % 5 <> 0"""

BINDINGS["described_sources"] = lambda d: f"""
SELECT run_id, module_key, pos, source_alias, source_table, source_kind,
       CASE WHEN pos % 3 = 0 THEN 'Contiene ' || source_alias END AS contains_description,
       CASE WHEN pos % 4 = 0 THEN '' WHEN pos % 4 = 1 THEN 'RAW' WHEN pos % 4 = 2 THEN 'CURADO' END AS layer
FROM {{run_module_sources}}"""

BINDINGS["stored_files"] = lambda d: f"""
SELECT run_id, pos, relative_path, size_bytes,
       CASE WHEN pos % 2 = 0 THEN 'runs/' || run_id || '/' || relative_path END AS storage_path
FROM {{run_files}}"""
