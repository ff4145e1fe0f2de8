"""Bindings of contract side tables, audited documents and scripts."""

from __future__ import annotations

from ledgerloom.functions import fixed_values as fixed
from suite.catalog_inputs import text
from suite.lab import BINDINGS

NL = "chr(10)"
DOLLAR = "chr(36)"


def var(name: str) -> str:
    """A ``${name}`` token; spelled apart because both engines' callers substitute such text."""
    return f"{DOLLAR} || '{{{{{name}}}}}'"


FIELD = (
    "CASE l_partkey % 9 WHEN 0 THEN 'Fec_' WHEN 1 THEN 'hora_' WHEN 2 THEN 'es_' WHEN 3 THEN 'Saldo_' WHEN 4 THEN 'x' "
    "WHEN 5 THEN 'nom2bre_' WHEN 6 THEN 'cod_' WHEN 7 THEN 'id_' ELSE 'clave_' END || alias"
)
TABLE = "'cd_lin.' || run_id"

BINDINGS["contract_columns"] = lambda d: f"""
SELECT {TABLE} AS table_name, pos AS position, {FIELD} AS field_name,
       CASE WHEN l_partkey % 2 = 0 THEN 'D' ELSE 'T' END AS field_type, 'Campo ' || alias AS description,
       CASE l_partkey % 5 WHEN 0 THEN {d.strings("'count'")} WHEN 1 THEN {d.strings("'TRIM'", "'SUM'")}
            ELSE {d.no_strings} END AS functions
FROM {{lines}}"""

BINDINGS["contract_profile"] = lambda d: f"""
SELECT {TABLE} AS table_name, upper({FIELD}) AS field_name, 'BIGINT' AS physical_type, 'integer' AS logical_type,
       l_partkey % 2 = 0 AS required, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'ej' || p END AS example
FROM {{lines}} WHERE l_linenumber IN (1, 2, 3)"""

BINDINGS["contract_ddl"] = lambda d: f"""
SELECT {TABLE} AS table_name, {FIELD} AS field_name, 'STRING' AS physical_type, 'string' AS logical_type,
       l_partkey % 3 = 0 AS required, l_partkey % 11 = 0 AS partitioned
FROM {{lines}} WHERE l_linenumber IN (2, 3, 4, 5)"""

BINDINGS["contract_sample"] = lambda d: f"""
SELECT {TABLE} AS table_name, lower({FIELD}) AS field_name, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'csv' || p END AS example
FROM {{lines}} WHERE l_linenumber IN (3, 5, 6)"""

BINDINGS["contract_dictionary"] = lambda d: f"""
SELECT {TABLE} AS table_name, {FIELD} AS field_name, 'Nombre ' || p AS business_name,
       CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'Dic ' || p END AS description
FROM {{lines}} WHERE l_linenumber IN (1, 4, 6)"""

BINDINGS["contract_products"] = lambda d: f"""
SELECT {TABLE} AS table_name, 'Producto  Núm. ' || {text('l_orderkey')} AS product,
       CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'Captacion Vista' END AS domain,
       CASE WHEN l_orderkey % 2 = 0 THEN 'Publicar cuentas' ELSE '' END AS purpose, 'Diaria' AS frequency,
       CASE WHEN l_orderkey % 5 = 0 THEN 'Una fila por cuenta' END AS granularity,
       '2001-08-02T00:00:00Z' AS created
FROM {{lines}} GROUP BY run_id, l_orderkey"""

BINDINGS["profiled_tables"] = lambda d: f"""
SELECT CAST(c_nationkey % 2 AS INT) AS database_rank,
       CASE WHEN c_nationkey % 5 = 0 THEN 'main' ELSE 'esq' || {text('c_nationkey')} END AS schema_name,
       CASE WHEN c_custkey % 2 = 0 THEN 'cd_tabla_' ELSE 'CD-Tabla' END || {text('c_custkey')} AS table_name
FROM {{customer}}"""

BINDINGS["table_requests"] = lambda d: f"""
SELECT o_orderkey AS request_id, 1 AS request_rank,
       CASE o_orderkey % 4 WHEN 0 THEN 'otro.CD_TABLA_' || {text('o_custkey')} WHEN 1 THEN 'x.cdtabla' || {text('o_custkey')}
            WHEN 2 THEN 'esq3.cd_tabla_' || {text('o_custkey')} ELSE 'nada_' || {text('o_custkey')} END AS requested
FROM {{orders}}
UNION ALL SELECT o_orderkey, 2, ' cd tabla ' || {text('o_custkey')} FROM {{orders}} WHERE o_orderstatus = 'F'"""

BINDINGS["ddl_texts"] = lambda d: f"""
SELECT 'ddl/' || {text('p_partkey')} || '.txt' AS path,
       'CREATE TABLE ws_cd.cd_p' || {text('p_partkey')} || ' (' || {NL} || 'id_cuenta STRING,' || {NL} ||
       '  Fec_Carga TIMESTAMP NOT NULL,' || {NL} || 'sld_actual DECIMAL(32, 2),' || {NL} ||
       CASE p_size % 3 WHEN 0 THEN 'num_' || lower(p_type) || ' bigint not null' WHEN 1 THEN 'ind_nuevo Boolean'
            ELSE 'id_cuenta DATE' END || {NL} || ')' || {NL} ||
       CASE WHEN p_size % 2 = 0 THEN 'PARTITIONED BY (' || {NL} || 'cod_titular STRING' || {NL} || ')' || {NL} ELSE '' END ||
       'STORED AS PARQUET' || {NL} || ';' AS text
FROM {{part}}"""

BINDINGS["dictionary_texts"] = lambda d: f"""
SELECT 'dic/' || {text('p_partkey')} || '.txt' AS path,
       '| Nombre   | Descripción |' || {NL} || '| -------- | --- |' || {NL} || '  | id_cuenta | Cuenta ' || p_name || ' |' ||
       {NL} || 'nota suelta' || {NL} || '|sld_' || lower(p_type) || '2x|Saldo|extra|' || {NL} || '| sola |' ||
       CASE WHEN p_size % 4 = 0 THEN {NL} || '| ID_CUENTA | Repetida |' ELSE '' END AS text
FROM {{part}}"""


def _titles(values: list[str]) -> list[str]:
    return [
        f"CASE WHEN doc_id % 9 = {n} THEN 'Anexo ' || CAST(doc_id % 9 AS STRING) ELSE '{title}' END"
        for n, title in enumerate(values)
    ]


BINDINGS["audit_documents"] = lambda d: f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'step' ELSE 'structural' END AS document_kind,
       CASE WHEN doc_id % 3 = 0 THEN {d.strings(*_titles(fixed.STEP_SECTIONS))}
            ELSE {d.strings(*_titles(fixed.STRUCTURAL_SECTIONS))} END AS section_titles,
       text ||
       CASE WHEN doc_id % 4 = 0 THEN ' RN-0' || CAST(doc_id % 9 AS STRING) || ', RN-77 y RN-123' ELSE '' END ||
       CASE doc_id % 7 WHEN 0 THEN {NL} || 'SELECT a' || {NL} || 'FROM b' WHEN 1 THEN ' insert  OVERWRITE x'
            WHEN 2 THEN ' Compute' || chr(9) || 'Stats y ' || {var('fec_ini')} WHEN 3 THEN ' fromselect(a)from join b on c'
            WHEN 4 THEN ' selected from b' ELSE '' END AS text,
       CASE WHEN doc_id % 5 = 0 THEN {d.strings("'RN-02'", "'RN-55'")} ELSE {d.no_strings} END AS referenced_rule_ids,
       CASE WHEN doc_id % 6 = 0 THEN 'borrador_' ELSE 'DA_REQ_CD_IT_' END || source || '.docx' AS file_name,
       CASE WHEN doc_id % 8 = 0 THEN {d.strings(var('num_x'), var('esquema_cu'))} ELSE {d.no_strings} END AS unresolved,
       {d.pair(var('fec_ini'), "'2001-08-02'", 'doc_id % 2 = 0')} AS inferred
FROM {{documents}}"""

BINDINGS["final_fields"] = lambda d: "SELECT l_orderkey AS doc_id, 'campo_' || alias AS field_name FROM {lines}"
BINDINGS["section_4"] = lambda d: """
SELECT l_orderkey AS doc_id, 'campo_' || alias AS field_name FROM {lines} WHERE l_linenumber <> 2"""
BINDINGS["section_5"] = lambda d: """
SELECT l_orderkey AS doc_id, 'campo_' || alias AS field_name FROM {lines} WHERE l_linenumber < 5"""
BINDINGS["defined_rules"] = lambda d: """
SELECT l_orderkey AS doc_id, 'RN-0' || CAST(l_linenumber AS STRING) AS rule_id FROM {lines}"""

BINDINGS["label_findings"] = lambda d: """
SELECT doc_id, 'error' AS severity FROM {labels} WHERE quality = 0
UNION ALL SELECT doc_id, 'warning' FROM {labels} WHERE toxic = 1"""

BINDINGS["scripts"] = lambda d: f"""
SELECT 'sql/' || source || '/' || {text('doc_id')} || '.sql' AS path,
       '--| @NOMBRE: proc_' || {text('doc_id')} || {NL} || '--| @DESCRIPCION:' || {NL} ||
       '--|     # ' || source || ' ' || lang || {NL} || '--| @PARAMETROS' || {NL} || '--|     #' || {NL} ||
       '--| @NOMBRE  otro_' || lang || {NL} ||
       '--drop table x; -- viejo; insert overwrite table no' || {NL} || ';' || {NL} ||
       'INSERT OVERWRITE TABLE ' || {var('esquema_cu')} || '.cu_s' || {text('doc_id % 300')} || {NL} ||
       'SELECT a, b FROM rd_lin.rd_' || source || ' t1' || {NL} ||
       'left join ' || {var('esquema_cu')} || '.cu_s' || {text('(doc_id * 7) % 500')} || ' t2 ON t1.id = t2.id' || {NL} ||
       ' WHERE fec = ' || {var('fec_ini_sem')} || ' AND x = ' || {DOLLAR} || '{{{{faltante_' || lang || '}}}}' || {NL} || ';' || {NL} ||
       CASE WHEN doc_id % 2 = 0 THEN 'create table cd_lin.cd_' || {text('doc_id')} || ' stored as parquet as' || {NL} ||
              'select * from cu_lin.c' || {text('doc_id')} || ';' || {NL} || 'COMPUTE STATS cd_lin.CD_' || {text('doc_id')} || ';'
            WHEN doc_id % 3 = 0 THEN 'Create Table If Not Exists cd_lin.n' || {text('doc_id')} || ' as select 1;' || {NL} ||
              'insert into cd_lin.i' || {text('doc_id')} || ' select 2;' || {NL} ||
              'insert into table cd_lin.j' || {text('doc_id')} || ' select 3;' || {NL} ||
              'INSERT OVERWRITE cd_lin.k' || {text('doc_id')} || ' select 4;'
            ELSE 'create table cd_lin.w' || {text('doc_id')} || ' as with z as (s) select * from z;' END || {NL} || text AS text
FROM {{documents}}"""

BINDINGS["configured_variables"] = lambda d: f"""
SELECT {DOLLAR} || '{{{{' || CASE n_nationkey WHEN 0 THEN 'esquema_cu' WHEN 1 THEN 'num_periodo_mes' ELSE lower(n_name) END ||
       '}}}}' AS token, 'valor_' || {text('n_nationkey')} AS value
FROM {{nation}}"""

BINDINGS["page_files"] = lambda d: f"""
SELECT relative_path, size_bytes FROM {{run_files}}"""

BINDINGS["named_nodes"] = lambda d: """
SELECT source_table AS name FROM {run_module_sources} UNION ALL SELECT source_node FROM {run_relations}
UNION ALL SELECT target_node FROM {run_relations}"""

