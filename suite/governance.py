"""Contract, audit and script-corpus queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fixed_values as fixed
from ledgerloom.functions import naming
from ledgerloom.plans import audit, contracts, scripts
from ledgerloom.session import scratch_path
from ledgerloom.sources import tables, text
from suite import governance_inputs  # noqa: F401  (registers the bindings)
from suite.lab import CHECKS, PARAMS, Lab
from suite.lineage import GROUP_SQL

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(Lab(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


# ---------------------------------------------------------------- profiles and side tables


def _profile_sql() -> str:
    columns = [
        ("o_orderkey", "BIGINT", "integer", "CAST(o_orderkey AS STRING)"),
        ("o_custkey", "BIGINT", "integer", "CAST(o_custkey AS STRING)"),
        ("o_orderstatus", "STRING", "string", "o_orderstatus"),
        ("o_totalprice", "DOUBLE", "number", "CAST(o_totalprice AS STRING)"),
        ("o_orderdate", "TIMESTAMP_NTZ", "timestamp", "CAST(o_orderdate AS STRING)"),
        ("o_orderpriority", "STRING", "string", "o_orderpriority"),
    ]
    head = "{{orders}}"
    parts = [
        f"SELECT CAST({n} AS INT) AS position, '{name}' AS field_name, '{kind}' AS physical_type, '{logical}' AS logical_type, "
        f"FALSE AS required, (SELECT arg_min({shown}, o_orderkey) FROM {head} WHERE {name} IS NOT NULL) AS example, "
        f"count(*) AS row_count, count(*) - count({name}) AS null_count FROM {{{{orders}}}}"
        for n, (name, kind, logical, shown) in enumerate(columns, start=1)
    ]
    return " UNION ALL ".join(parts).replace("{{", "{").replace("}}", "}")


@query("table_profile", _profile_sql())
def table_profile(lab: Lab) -> DataFrame:
    return tables.column_profile(lab["orders"], ["o_orderkey"])


def sql_compact(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '', 'g'), ''), 'datacontract')"


@query(
    "table_match",
    f"""
WITH names AS (
  SELECT *, 'name' AS kind, lower(table_name) AS key FROM {{profiled_tables}}
  UNION ALL SELECT *, 'name', lower(schema_name || '.' || table_name) FROM {{profiled_tables}}
  UNION ALL SELECT *, 'compact', {sql_compact('table_name')} FROM {{profiled_tables}}),
found AS (SELECT kind, key, database_rank, max(struct_pack(s := schema_name, t := table_name)) AS hit FROM names GROUP BY ALL),
tries AS (
  SELECT request_id, request_rank, 1 AS tier, 'name' AS kind, lower(trim(requested)) AS key FROM {{table_requests}}
  UNION ALL SELECT request_id, request_rank, 2, 'name', lower(regexp_extract(trim(requested), '[^.]*$')) FROM {{table_requests}}
  UNION ALL SELECT request_id, request_rank, 3, 'compact', {sql_compact("regexp_extract(trim(requested), '[^.]*$')")}
  FROM {{table_requests}}),
best AS (
  SELECT request_id, database_rank, tier, hit.s AS schema_name, hit.t AS table_name
  FROM tries JOIN found USING (kind, key)
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY database_rank, request_rank, tier, hit) = 1)
SELECT r.request_id, b.database_rank, b.tier, b.schema_name, b.table_name
FROM (SELECT DISTINCT request_id FROM {{table_requests}}) r LEFT JOIN best b ON b.request_id = r.request_id""",
)
def table_match(lab: Lab) -> DataFrame:
    return contracts.matched_tables(lab["table_requests"], lab["profiled_tables"])


@query(
    "ddl_fields",
    r"""
WITH blocks AS (
  SELECT path, regexp_extract(text, 'CREATE\s+TABLE\s+([^\s(]+)\s*\(', 1, 'i') AS table_name,
         regexp_extract(text, 'CREATE\s+TABLE\s+[^\s(]+\s*\((.*?)\)\s*(?:PARTITIONED\s+BY|STORED|;)', 1, 'is') AS body,
         regexp_extract(text, 'PARTITIONED\s+BY\s*\((.*?)\)\s*(?:STORED|;)', 1, 'is') AS parts
  FROM {ddl_texts}),
lines AS (
  SELECT path, table_name, FALSE AS partitioned, unnest(l) AS line, generate_subscripts(l, 1) AS ord
  FROM (SELECT *, string_split(body, chr(10)) AS l FROM blocks)
  UNION ALL
  SELECT path, table_name, TRUE, unnest(l), generate_subscripts(l, 1)
  FROM (SELECT *, string_split(parts, chr(10)) AS l FROM blocks)),
fields AS (
  SELECT *, regexp_extract(trim(line), '^([A-Za-z0-9_]+)\s', 1) AS name,
         upper(replace(regexp_extract(trim(line), '^[A-Za-z0-9_]+\s+([A-Za-z]+(\s*\([0-9, ]+\))?)', 1), ' ', '')) AS kind
  FROM lines WHERE trim(line) <> '')
SELECT path, table_name, lower(name) AS field_name, kind AS physical_type,
       CASE WHEN starts_with(kind, 'STRING') THEN 'string' WHEN kind = 'BIGINT' THEN 'integer'
            WHEN starts_with(kind, 'DECIMAL') THEN 'number' WHEN kind = 'BOOLEAN' THEN 'boolean'
            WHEN kind = 'TIMESTAMP' THEN 'timestamp' ELSE 'date' END AS logical_type,
       contains(upper(line), 'NOT NULL') AS required, partitioned
FROM fields QUALIFY row_number() OVER (PARTITION BY path, lower(name) ORDER BY partitioned DESC, ord DESC) = 1""".replace(
        "{0,}", "*"
    ),
)
def ddl_fields(lab: Lab) -> DataFrame:
    return text.ddl_fields(lab["ddl_texts"])


def sql_title(x: str) -> str:
    words = f"regexp_extract_all({x}, '[\\p{{L}}]+|[^\\p{{L}}]+')"
    return f"array_to_string(list_transform({words}, lambda w : upper(w[1]) || lower(w[2:])), '')"


@query(
    "dictionary_fields",
    f"""
WITH lines AS (
  SELECT path, trim(unnest(l)) AS line, generate_subscripts(l, 1) AS ord
  FROM (SELECT path, string_split(text, chr(10)) AS l FROM {{dictionary_texts}})),
cells AS (
  SELECT path, ord, list_transform(string_split(trim(line, '|'), '|'), lambda c : trim(c)) AS c FROM lines
  WHERE starts_with(line, '|'))
SELECT path, lower(c[1]) AS field_name, arg_max({sql_title("replace(c[1], '_', ' ')").replace('{', '{{').replace('}', '}}')}, ord) AS business_name,
       arg_max(c[2], ord) AS description
FROM cells WHERE len(c) >= 2 AND c[1] <> '' AND lower(c[1]) <> 'nombre' AND replace(c[1], '-', '') <> ''
GROUP BY path, lower(c[1])""",
)
def dictionary_fields(lab: Lab) -> DataFrame:
    return text.dictionary_fields(lab["dictionary_texts"])


CSV_ROWS = [
    "c_custkey AS Clave",
    "CASE WHEN c_custkey < 7 THEN '' ELSE c_name END AS Nombre",
    "CASE WHEN c_custkey < 3 THEN NULL ELSE c_mktsegment END AS segmento",
    "CAST(NULL AS STRING) AS vacia",
]


@query(
    "csv_profile",
    f"""
WITH r AS (SELECT {', '.join(CSV_ROWS)} FROM {{customer}})
SELECT count(*) AS row_count, 'clave' AS field_name, CAST(min(Clave) AS STRING) AS example FROM r
UNION ALL SELECT count(*), 'nombre', arg_min(Nombre, Clave) FILTER (Nombre <> '') FROM r
UNION ALL SELECT count(*), 'segmento', arg_min(segmento, Clave) FILTER (segmento <> '') FROM r
UNION ALL SELECT count(*), 'vacia', NULL FROM r""",
)
def csv_profile(lab: Lab) -> DataFrame:
    """Customers are written as CSV in key order, then profiled from the files."""
    path = scratch_path(lab.spark, "customers")
    lab["customer"].selectExpr(*CSV_ROWS).orderBy("Clave").write.option("header", True).csv(path)
    return text.csv_profile(lab.spark, path)


@query(
    "csv_clean_nul",
    "SELECT c_custkey AS clave, c_name AS nombre, CAST(c_nationkey AS INT) AS nacion FROM {customer}",
)
def csv_clean_nul(lab: Lab) -> DataFrame:
    """Customers with NUL characters in them are written as CSV, and read from the cleaned files."""
    path = scratch_path(lab.spark, "nul")
    nul = F.lit("\u0000")
    rows = lab["customer"].select(
        F.concat("c_custkey", nul).alias("clave"),
        F.concat(F.substring("c_name", 1, 4), nul, F.expr("substr(c_name, 5)")).alias("nombre"),
        F.concat(nul, F.col("c_nationkey").cast("string")).alias("nacion"),
    )
    rows.write.option("header", True).csv(path)
    return text.read_dirty_csv(lab.spark, path, "clave bigint, nombre string, nacion int").select("clave", "nombre", "nacion")


@query(
    "csv_records",
    """
SELECT c_custkey AS clave, c_name || chr(10) || 'de "' || c_mktsegment || '", ' || chr(10) || chr(10) || 'fin' AS nombre,
       CASE WHEN c_custkey % 50 <> 0 THEN CAST(c_nationkey AS INT) END AS nacion, c_custkey % 50 = 0 AS ilegible
FROM {customer}""",
)
def csv_records(lab: Lab) -> DataFrame:
    """Customers whose names hold line breaks, quotes and commas, some with a nation that is no number."""
    path = scratch_path(lab.spark, "records")
    name = F.concat("c_name", F.lit('\nde "'), "c_mktsegment", F.lit('", \n\u0000\nfin'))
    nation = F.when(F.col("c_custkey") % 50 == 0, "sin dato").otherwise(F.col("c_nationkey").cast("string"))
    rows = lab["customer"].select(F.col("c_custkey").alias("clave"), name.alias("nombre"), nation.alias("nacion"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    read = text.read_dirty_csv(lab.spark, path, "clave bigint, nombre string, nacion int")
    return read.select("clave", "nombre", "nacion", F.col("unreadable").isNotNull().alias("ilegible"))


# ---------------------------------------------------------------- contracts


def sql_inferred(name: str, functions: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower({name}), '{'|'.join(tokens)}') THEN '{kind}'" for kind, tokens in fixed.NAME_TYPES
    )
    counted = f"list_has_any(list_transform({functions}, lambda f : upper(f)), ['COUNT', 'SUM'])"
    return f"CASE {whens} WHEN {counted} THEN 'number' ELSE 'string' END"


@query(
    "infer_logical_type",
    f"SELECT table_name, field_name, {sql_inferred('field_name', 'functions')} AS logical_type FROM {{contract_columns}}",
)
def infer_logical_type(lab: Lab) -> DataFrame:
    kind = naming.inferred_type(F.col("field_name"), F.col("functions"))
    return lab["contract_columns"].select("table_name", "field_name", kind.alias("logical_type"))


CHECKS["contract_rows_all"] = f"""
SELECT c.table_name, c.position, c.field_name,
       coalesce(p.logical_type, d.logical_type, {sql_inferred('c.field_name', 'c.functions')}) AS logical_type,
       coalesce(d.physical_type, p.physical_type) AS physical_type,
       coalesce(nullif(w.description, ''), c.description) AS description,
       coalesce(p.required, d.required, FALSE) AS required,
       coalesce(w.business_name, {sql_title("replace(c.field_name, '_', ' ')").replace('{', '{{').replace('}', '}}')}) AS business_name,
       c.field_type AS classification, coalesce(d.partitioned, FALSE) AS partitioned,
       nullif(CASE WHEN p.table_name IS NOT NULL THEN p.example ELSE s.example END, '') AS example
FROM {{contract_columns}} c
LEFT JOIN {{contract_profile}} p ON p.table_name = c.table_name AND lower(p.field_name) = lower(c.field_name)
LEFT JOIN {{contract_ddl}} d ON d.table_name = c.table_name AND lower(d.field_name) = lower(c.field_name)
LEFT JOIN {{contract_sample}} s ON s.table_name = c.table_name AND lower(s.field_name) = lower(c.field_name)
LEFT JOIN {{contract_dictionary}} w ON w.table_name = c.table_name AND lower(w.field_name) = lower(c.field_name)"""


def _contract_fields(lab: Lab, columns: DataFrame | None = None) -> DataFrame:
    return contracts.contract_fields(
        lab["contract_columns"] if columns is None else columns,
        lab["contract_profile"],
        lab["contract_ddl"],
        lab["contract_sample"],
        lab["contract_dictionary"],
    )


@query("contract_fields", "SELECT * FROM {contract_rows_all}")
def contract_fields(lab: Lab) -> DataFrame:
    return _contract_fields(lab)


@query(
    "contract_doc",
    r"""
SELECT c.table_name, 'property' AS part, CAST(position AS BIGINT) AS position, CAST(NULL AS BIGINT) AS field_count,
    '{{"name":"' || field_name || '","logicalType":"' || logical_type || '"' ||
    coalesce(',"physicalType":"' || physical_type || '"', '') || ',"description":"' || description || '","required":' ||
    CAST(required AS STRING) || ',"businessName":"' || business_name || '","classification":"' || classification || '"' ||
    CASE WHEN partitioned THEN ',"partitioned":true,"partitionKeyPosition":1' ELSE '' END ||
    coalesce(',"examples":["' || example || '"]', '') || '}}' AS body
FROM {contract_rows_all} c SEMI JOIN {contract_products} p ON p.table_name = c.table_name
UNION ALL
SELECT p.table_name, 'contract', 0, n,
  '{{"apiVersion":"v3.1.0","kind":"DataContract","id":"' || regexp_replace(lower(p.table_name), '[^a-z0-9]+', '-', 'g') ||
  '","name":"' || regexp_replace(lower(c.product), '[^a-z0-9]+', '-', 'g') || '","version":"0.1.0","status":"active"' ||
  CASE WHEN domain <> '' THEN ',"domain":"' || domain || '"' ELSE '' END || ',"dataProduct":"' || product ||
  '","description":{{"purpose":"' ||
  CASE WHEN purpose <> '' THEN purpose ELSE 'Contrato del dataset ' || p.table_name || '.' END ||
  '","usage":"Frecuencia: ' || frequency || '."}},"tags":[' ||
  CASE WHEN domain <> '' THEN '"' || replace(lower(domain), ' ', '_') || '",' ELSE '' END || '"' || lower(frequency) ||
  '"],"schema":[{{"name":"' || split_part(p.table_name, '.', 2) || '","physicalName":"' || p.table_name ||
  '","logicalType":"object","physicalType":"table","description":"' ||
  CASE WHEN purpose <> '' THEN purpose ELSE 'Modelo tabular publicado en ' || p.table_name || '.' END ||
  '","dataGranularityDescription":"' || coalesce(granularity, 'Una fila por registro publicado en ' || p.table_name || '.') ||
  '"}}],"contractCreatedTs":"' || created || '"}}' AS contract
FROM (SELECT table_name, count(*) AS n FROM {contract_rows_all} GROUP BY table_name) p
JOIN {contract_products} c ON c.table_name = p.table_name""",
)
def contract_doc(lab: Lab) -> DataFrame:
    products = lab["contract_products"]
    columns = contracts.of_products(lab["contract_columns"], products)
    return contracts.contract_documents(_contract_fields(lab, columns), products)


# ---------------------------------------------------------------- names


@query(
    "slugify",
    f"""
SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'datacontract') AS ascii,
       coalesce(nullif(trim(regexp_replace(lower(trim(html)), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+', '-', 'g'), '-'), ''), 'data_product') AS cuerpo,
       split_part(url, '.', 1) AS antes, substr(url, instr(url, '.') + 1) AS despues,
       regexp_extract(url, '^(.*)\\.([^.]*)$', 1) AS espacio, regexp_extract(url, '^(.*)\\.([^.]*)$', 2) AS hoja
FROM {{pages}}""",
)
def slugify(lab: Lab) -> DataFrame:
    first, last = naming.split_first_dot(F.col("url")), naming.split_last_dot(F.col("url"))
    return lab["pages"].select(
        "page_id",
        naming.ascii_slug(F.col("url")).alias("ascii"),
        naming.unicode_slug(F.col("html")).alias("cuerpo"),
        first[0].alias("antes"),
        first[1].alias("despues"),
        last[0].alias("espacio"),
        last[1].alias("hoja"),
    )


@query(
    "detect_layer",
    f"""
SELECT name, layer, grupo, count(*) AS veces FROM (
  SELECT name, CASE WHEN starts_with(leaf, 'cd_') THEN 'Crystal (cd_)' WHEN starts_with(leaf, 'rd_') THEN 'Raw (rd_)'
                    WHEN starts_with(leaf, 'cu_') THEN 'Curada (cu_)' ELSE 'Logica derivada' END AS layer,
         {GROUP_SQL.format(x='name', kind="''")} AS grupo
  FROM (SELECT name, regexp_extract(lower(trim(split_part(split_part(name, '(', 1), ',', 1))), '[^.]*$') AS leaf
        FROM {{named_nodes}}))
GROUP BY ALL""",
)
def detect_layer(lab: Lab) -> DataFrame:
    counted = lab["named_nodes"].groupBy("name").agg(F.count("*").alias("veces"))
    return counted.select(
        "name", naming.layer(F.col("name")).alias("layer"), naming.schema_group(F.col("name")).alias("grupo"), "veces"
    )


@query(
    "file_inventory",
    """
SELECT relative_path, CASE split_part(lower(relative_path), '/', 1) WHEN 'sql' THEN 'sql' WHEN 'metadata' THEN 'metadata'
         WHEN 'templates' THEN 'template' WHEN 'config.yml' THEN CASE lower(relative_path) WHEN 'config.yml' THEN 'config' ELSE 'other' END
         ELSE 'other' END AS file_category, size_bytes
FROM {page_files}""",
)
def file_inventory(lab: Lab) -> DataFrame:
    return text.inventory(lab["page_files"])


# ---------------------------------------------------------------- audit


def sql_titles(values: list[str]) -> str:
    return "[" + ", ".join(f"'{value}'" for value in values) + "]"


CHECKS["sections"] = f"""
SELECT doc_id, list_sort(list_filter(need, lambda t : NOT list_contains(section_titles, t))) AS missing,
       list_sort(list_filter(section_titles, lambda t : NOT list_contains(need, t))) AS extra
FROM (SELECT *, CASE document_kind WHEN 'step' THEN {sql_titles(fixed.STEP_SECTIONS)}
                ELSE {sql_titles(fixed.STRUCTURAL_SECTIONS)} END AS need FROM {{audit_documents}})"""

CHECKS["section_rows"] = """
SELECT doc_id, 'error' AS severity, 'Faltan secciones obligatorias: ' AS message, unnest(missing) AS item FROM {sections}
UNION ALL
SELECT doc_id, 'warning', 'Se detectaron secciones adicionales: ', unnest(extra) FROM {sections}"""


@query("audit_sections", "SELECT * FROM {section_rows}")
def audit_sections(lab: Lab) -> DataFrame:
    return audit.section_findings(lab["audit_documents"])


CHECKS["missing"] = """
SELECT doc_id, field_name, 'error' AS severity, '4' AS section FROM (
  SELECT doc_id, field_name FROM {final_fields} EXCEPT SELECT doc_id, field_name FROM {section_4})
UNION ALL
SELECT doc_id, field_name, 'error', '5' FROM (
  SELECT doc_id, field_name FROM {final_fields} EXCEPT SELECT doc_id, field_name FROM {section_5})"""


@query("audit_missing_fields", "SELECT * FROM {missing}")
def audit_missing_fields(lab: Lab) -> DataFrame:
    return audit.missing_fields(lab["final_fields"], {"4": lab["section_4"], "5": lab["section_5"]})


CHECKS["named_rules"] = r"""
SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\bRN-[0-9][0-9]\b')) AS rule_id FROM {audit_documents}"""


@query("rule_refs", "SELECT * FROM {named_rules}")
def rule_refs(lab: Lab) -> DataFrame:
    return audit.rule_references(lab["audit_documents"])


CHECKS["undefined"] = """
SELECT doc_id, rule_id, 'error' AS severity FROM (
  SELECT doc_id, rule_id FROM {named_rules}
  UNION SELECT doc_id, unnest(referenced_rule_ids) FROM {audit_documents}
  EXCEPT SELECT doc_id, rule_id FROM {defined_rules})"""


@query("audit_undefined_rules", "SELECT * FROM {undefined}")
def audit_undefined_rules(lab: Lab) -> DataFrame:
    return audit.undefined_rules(lab["audit_documents"], lab["defined_rules"])


W = r"[^\p{{L}}\p{{N}}_]"
CHECKS["markers"] = rf"""
SELECT doc_id, concat_ws(', ', CASE WHEN regexp_matches(t, '(^|{W})compute stats({W}|$)') THEN 'compute stats' END,
         CASE WHEN regexp_matches(t, '(^|{W})insert({W}|$)') THEN 'insert' END,
         CASE WHEN regexp_matches(t, '(^|{W})insert overwrite({W}|$)') THEN 'insert overwrite' END,
         CASE WHEN regexp_matches(t, '(^|{W})join{W}(.*{W})?on({W}|$)', 's') THEN 'join on' END,
         CASE WHEN regexp_matches(t, '(^|{W})select{W}(.*{W})?from({W}|$)', 's') THEN 'select from' END,
         CASE WHEN regexp_matches(t, '[$]\{{{{[^}}}}]+\}}}}') THEN 'variable sin resolver' END) AS markers
FROM (SELECT doc_id, regexp_replace(lower(text), '[\s\x0b\x1c-\x1f\x{{{{85}}}}\p{{{{Z}}}}]+', ' ', 'g') AS t FROM {{audit_documents}})"""
CHECKS["markers"] = CHECKS["markers"].replace("\\p{L}", "\\p{{L}}").replace("\\p{N}", "\\p{{N}}")


@query("text_sql_markers", "SELECT * FROM {markers}")
def text_sql_markers(lab: Lab) -> DataFrame:
    return audit.marked_texts(lab["audit_documents"]).withColumn("markers", F.array_join("markers", ", "))


CHECKS["finding_items"] = """
SELECT * FROM {section_rows}
UNION ALL
SELECT DISTINCT doc_id, 'error', 'Faltan campos finales en Seccion ' || section || ': ', field_name FROM {missing}
UNION ALL
SELECT doc_id, 'error', 'Hay reglas referenciadas que no existen en Seccion 6: ', rule_id FROM {undefined}
UNION ALL
SELECT doc_id, 'error', 'Se detectaron patrones de SQL literal en el documento: ', unnest(string_split(markers, ', '))
FROM {markers} WHERE markers <> ''
UNION ALL
SELECT doc_id, 'error', 'El nombre del documento de salida debe iniciar con DA_REQ_CD_IT_: ', file_name
FROM {audit_documents} WHERE NOT starts_with(file_name, 'DA_REQ_CD_IT_')
UNION ALL
SELECT doc_id, 'error', 'Quedaron variables sin resolver en el SQL: ', unnest(unresolved) FROM {audit_documents}
UNION ALL
SELECT doc_id, 'warning', 'Se resolvieron variables con valores inferidos: ',
       unnest(list_transform(map_entries(inferred), lambda e : e.key || '=' || e.value))
FROM {audit_documents} WHERE len(unresolved) = 0"""

CHECKS["findings"] = """
SELECT doc_id, severity, message, CAST(NULL AS VARCHAR) AS item, count(*) AS item_count FROM {finding_items} GROUP BY ALL
UNION ALL
SELECT doc_id, severity, message, item, NULL FROM {finding_items}"""


def _findings(lab: Lab) -> DataFrame:
    return audit.audit_findings(
        lab["audit_documents"], lab["final_fields"], lab["section_4"], lab["section_5"], lab["defined_rules"]
    )


@query("audit_findings", "SELECT * FROM {findings}")
def audit_findings(lab: Lab) -> DataFrame:
    return _findings(lab)


@query(
    "audit_summary",
    """
SELECT d.doc_id, count(*) FILTER (f.severity = 'error') AS error_count, count(*) FILTER (f.severity = 'warning') AS warning_count,
       count(*) FILTER (f.severity = 'error') = 0 AS passed
FROM {documents} d LEFT JOIN {label_findings} f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def audit_summary(lab: Lab) -> DataFrame:
    return audit.audit_summary(lab["documents"], lab["label_findings"])


# ---------------------------------------------------------------- scripts


def _script_folder(lab: Lab) -> str:
    """Scripts written as one file each, in a folder named by the script."""
    path = scratch_path(lab.spark, "scripts")
    name = F.coalesce(F.nullif(F.regexp_replace("path", "[^A-Za-z0-9]+", "_"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    text.write_texts(lab["scripts"].select(F.concat(F.lit("script="), name, F.lit("/part.txt")).alias("file"), "text"), path)
    return path


NAMED = "regexp_replace(path, '[^A-Za-z0-9]+', '_', 'g')"


@query("script_files", f"SELECT {NAMED} AS script, sha256(text || chr(10)) AS text_hash FROM {{scripts}}")
def script_files(lab: Lab) -> DataFrame:
    read = text.read_scripts(lab.spark, _script_folder(lab), pattern="*.txt")
    return read.select(
        F.regexp_extract("path", "script=([^/]+)/", 1).alias("script"), F.sha2(F.col("text").cast("binary"), 256).alias("text_hash")
    )


@query(
    "folder_inventory",
    f"SELECT 'script=' || {NAMED} AS folder, 'other' AS file_category, octet_length(encode(text)) + 1 AS size_bytes FROM {{scripts}}",
)
def folder_inventory(lab: Lab) -> DataFrame:
    files = text.folder_inventory(lab.spark, _script_folder(lab)).where("relative_path LIKE '%.txt'")
    return files.select(F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("folder"), "file_category", "size_bytes")

TOKEN = r"'[$]\{{[^}}]+\}}'"
CHECKS["tokens"] = f"SELECT DISTINCT path, unnest(regexp_extract_all(text, {TOKEN})) AS token FROM {{scripts}}"


@query("script_variables", "SELECT * FROM {tokens}")
def script_variables(lab: Lab) -> DataFrame:
    return scripts.variables(lab["scripts"])


ENVIRONMENT = {"faltante_de": "entorno-de"}


@query(
    "variable_resolution",
    f"""
SELECT t.path, t.token,
       CASE WHEN v.value IS NOT NULL THEN v.value WHEN name = 'faltante_de' THEN 'entorno-de'
            WHEN dated THEN '{PARAMS.as_of.isoformat()}' END AS value,
       CASE WHEN v.value IS NOT NULL THEN 'configured' WHEN name = 'faltante_de' THEN 'environment'
            WHEN dated THEN 'inferred' ELSE 'unresolved' END AS status
FROM (SELECT *, substr(token, 3, length(token) - 3) AS name,
             regexp_matches(lower(substr(token, 3, length(token) - 3)), '^(fec_|fecha_)|_date$') AS dated FROM {{tokens}}) t
LEFT JOIN {{configured_variables}} v ON v.token = t.token""",
)
def variable_resolution(lab: Lab) -> DataFrame:
    return scripts.resolved_variables(lab["scripts"], lab["configured_variables"], ENVIRONMENT, PARAMS.today)


@query(
    "variables_added",
    "SELECT token FROM {tokens} EXCEPT SELECT token FROM {configured_variables}",
)
def variables_added(lab: Lab) -> DataFrame:
    return scripts.added_variables(lab["scripts"], lab["configured_variables"])


@query(
    "script_headers",
    r"""
WITH lines AS (
  SELECT path, unnest(l) AS line, generate_subscripts(l, 1) AS ord, l
  FROM (SELECT path, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]') AS l FROM {scripts})),
entries AS (
  SELECT path, ord, regexp_extract(line, '^\s*--\|\s*@([A-Z_]+):?\s*(.*)$', 1) AS key,
         trim(regexp_extract(line, '^\s*--\|\s*@([A-Z_]+):?\s*(.*)$', 2)) AS v,
         trim(regexp_extract(l[ord + 1], '^\s*--\|\s*#\s*(.*)$', 1)) AS below
  FROM lines WHERE regexp_matches(line, '^\s*--\|\s*@[A-Z_]+'))
SELECT path, key, arg_max(CASE WHEN v NOT IN ('', '#', ':', '-') THEN v WHEN below IN ('#', ':', '-') THEN ''
                               ELSE coalesce(below, '') END, ord) AS value
FROM entries GROUP BY path, key""",
)
def script_headers(lab: Lab) -> DataFrame:
    return scripts.headers(lab["scripts"])


CHECKS["statements"] = r"""
SELECT path, unnest(parts) AS s, generate_subscripts(parts, 1) AS ord FROM (
  SELECT path, list_filter(list_transform(string_split(array_to_string(list_transform(string_split(text, chr(10)),
    lambda x : CASE WHEN contains(x, '--') THEN substr(x, 1, instr(x, '--') - 1) || replace(substr(x, instr(x, '--')), ';', ' ')
                    ELSE x END), chr(10)), ';'), lambda s : trim(s)), lambda s : s <> '') AS parts
  FROM {scripts})"""

CHECKS["publishing"] = r"""
SELECT path, ord, CASE WHEN i <> '' THEN i ELSE
         regexp_extract(s, '\bcreate\s+table\s+(if\s+not\s+exists\s+)?([^\s(;/]+).*?\bas\s+(with|select)\b', 2, 'is') END AS target,
       i <> '' AS inserted
FROM (SELECT *, regexp_extract(s, '\binsert\s+(overwrite|into)\s+(table\s+)?([^\s(;/]+)', 3, 'i') AS i FROM {statements})
WHERE NOT regexp_matches(s, '^\s*compute\s+stats\s', 'i')"""

CHECKS["published"] = r"""
SELECT path, ord, CASE WHEN i <> '' THEN i ELSE regexp_extract(s, 'create\s+table\s+([^\s(;/]+).*?\bas\s+select\b', 1, 'is') END AS t
FROM (SELECT *, regexp_extract(s, 'insert\s+overwrite\s+table\s+([^\s(;/]+)', 1, 'i') AS i FROM {statements})
WHERE NOT regexp_matches(s, '^\s*compute\s+stats\s', 'i')"""


@query(
    "script_outputs",
    """
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY ord) - 1 AS INT) AS position, t AS table_name
FROM (SELECT path, t, min(ord) AS ord FROM {published} WHERE t <> '' GROUP BY path, t)""",
)
def script_outputs(lab: Lab) -> DataFrame:
    return scripts.outputs(lab["scripts"])


@query(
    "script_sources",
    r"""
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY ord) - 1 AS INT) AS position, t AS table_name
FROM (SELECT path, t, min(ord) AS ord FROM (
        SELECT path, target, unnest(found) AS t, generate_subscripts(found, 1) AS ord
        FROM (SELECT path, regexp_extract_all(text, '\b(from|join)\s+([a-zA-Z0-9_$.]+)', 2, 'i') AS found,
                     lower(regexp_extract(text, '\b(insert\s+overwrite\s+table|insert\s+into|create\s+table(\s+if\s+not\s+exists)?)\s+([a-zA-Z0-9_$.]+)', 3, 'i')) AS target
              FROM {scripts})) WHERE lower(t) <> target GROUP BY path, t)""",
)
def script_sources(lab: Lab) -> DataFrame:
    return scripts.sources(lab["scripts"])


@query(
    "script_edges",
    r"""
WITH w AS (SELECT DISTINCT path, t FROM {published} WHERE t <> ''),
r AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '(from|join)\s+([a-zA-Z0-9_${{}}.]+)', 2, 'i')) AS t FROM {scripts})
SELECT path AS source_node, t AS target_node, 'writes' AS relation FROM w WHERE t IN (SELECT t FROM r)
UNION ALL
SELECT t, path, 'reads' FROM r WHERE t IN (SELECT t FROM w)""",
)
def script_edges(lab: Lab) -> DataFrame:
    return scripts.flow(lab["scripts"])


@query(
    "publication_roles",
    r"""
SELECT path, CAST(n AS INT) AS sequence, CASE WHEN inserted THEN 'insert_overwrite' ELSE 'create_table_as_select' END AS statement_type,
       target AS target_table, CASE WHEN n = max(n) OVER (PARTITION BY path) THEN 'final' ELSE 'intermedia' END AS role,
       EXISTS (SELECT 1 FROM {statements} s WHERE s.path = p.path
               AND lower(regexp_extract(s.s, '^\s*compute\s+stats\s+([^\s;]+)', 1, 'i')) = lower(p.target)) AS has_compute_stats
FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord) AS n FROM {publishing} WHERE target <> '') p""",
)
def publication_roles(lab: Lab) -> DataFrame:
    return scripts.publications(lab["scripts"])
