from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import audit, bundle, contracts, kpi, lineage, registry, runs, scripts
from ledgerloom.session import setting
from ledgerloom.sources import tables, text



def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_dashboard_tables(spark):
    customers = spark.sql(
        "SELECT * FROM VALUES (1,'Norte','Premium'),(2,'Norte','Masivo'),(3,'Sur','Masivo') AS t(cliente_id,region,segmento)"
    )
    accounts = spark.sql(
        "SELECT * FROM VALUES (11,1,'Ahorro','Activa',10.25BD),(12,1,'Nomina','Cancelada',0.00BD),(13,2,'Ahorro','Activa',99.00BD)"
        " AS t(cuenta_id,cliente_id,producto,estatus,saldo_actual)"
    )
    got = rows(
        kpi.region_summary(customers, accounts),
        "region", "segmento", "clientes", "cuentas", "cuentas_activas", "saldo_total",
    )
    assert [(*r[:5], r[5] and float(r[5])) for r in got] == [
        ("Sur", "Masivo", 1, 0, 0, None),
        ("Norte", "Masivo", 1, 1, 1, 99.0),
        ("Norte", "Premium", 1, 2, 1, 10.25),
    ]
    assert [r[0] for r in rows(kpi.top_accounts(customers, accounts, 2), "cuenta_id")] == [13, 11]


def test_schema_catalogue_from_csv_with_byte_order_mark(spark, tmp_path):
    file = tmp_path / "esquemas.csv"
    lines = ["esquema,descripcion,proposito", "rd_uno,Raw clientes,RAW", "stg_dos,Stage,TEMPORAL", "x_misc,,", ",,x"]
    file.write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
    got = registry.schema_catalog(text.read_csv(spark, str(file)), "esquemas.csv")
    assert rows(got, "schema_name", "schema_type", "is_temporary") == [
        ("rd_uno", "RAW", False),
        ("stg_dos", "TEMPORAL", True),
        ("x_misc", "NO CLASIFICADO", False),
    ]


def test_sources_are_cleaned_and_filled_from_edges(spark):
    names = [
        "raw.personas AS p",
        "CTE _tmp_clientes_ (derivada de raw.personas)",
        "raw.a AS a, raw.b AS b (subconsulta mix)",
        "_logical_tmp_ AS l",
    ]
    assets = spark.createDataFrame(
        [("r", n, name, "table") for n, name in enumerate(names)],
        "run_id string, pos bigint, qualified_name string, source_kind string",
    )
    edges = spark.createDataFrame(
        [("r", 1, "stg.orders", "table"), ("r", 2, "cte_union_orders", "process")],
        "run_id string, id bigint, source_node string, source_kind string",
    )
    got = registry.clean_sources(assets, edges).orderBy("rank", "pos")
    assert rows(got, "qualified_name") == [("raw.personas",), ("stg.orders",)]
    held = registry.clean_sources(assets, edges, spark.createDataFrame([("r",)], "run_id string"))
    assert rows(held, "qualified_name") == [("raw.personas",)]


def test_registry_replaces_source_assets_only_where_it_has_rows(spark):
    schema = "run_id string, asset_type string, qualified_name string, display_name string, role string, source_kind string"
    assets = spark.createDataFrame(
        [
            ("r", "dataset", "demo.target", "target", "target", None),
            ("r", "dataset", "sucia AS s", "s", "source", "table"),
            ("r", "file", "sql/a.sql", "a.sql", "evidence", None),
            ("q", "dataset", "otra.tabla", "tabla", "source", "table"),
        ],
        schema,
    )
    ready = spark.createDataFrame(
        [("r", "rd_uno.rd_clientes", "rd_clientes", None)],
        "run_id string, source_table string, source_object_name string, source_kind string",
    )
    got = registry.overlay_assets(assets, ready)
    assert sorted(rows(got, "run_id", "qualified_name", "role")) == [
        ("q", "otra.tabla", "source"),
        ("r", "demo.target", "target"),
        ("r", "rd_uno.rd_clientes", "source"),
        ("r", "sql/a.sql", "evidence"),
    ]


def test_invalid_control_rows(spark):
    df = spark.createDataFrame(
        [("a", "pending", "idle"), ("b", "raro", "executed"), ("c", None, "roto")],
        "run_id string, review_status string, last_import_status string",
    )
    got = registry.invalid_rows(df, registry.CONTROL_RULES)
    assert sorted(rows(got, "run_id", "broken_rules")) == [("b", "review_status"), ("c", "last_import_status")]


def run_rows(spark, extra):
    return spark.createDataFrame(
        [
            (f"run-{n}", datetime(2026, 5, day), "p", "f.sql", "demo.x", table, stored)
            for n, (day, table, stored) in enumerate(extra)
        ],
        "run_id string, created_at timestamp_ntz, product_name string, sql_file_name string, "
        "final_table_name string, target_table string, storage_objects string",
    )


def test_latest_contract_per_table_scans_before_it_searches(spark):
    listed = run_rows(
        spark,
        [
            (1, "demo.clientes", "{}"),
            (3, "Demo.Clientes", '{"datacontract_yaml": "a/b.yaml"}'),
            (2, "demo.cuentas", "{}"),
            (4, "demo.nada", "{}"),
        ],
    )
    analysis = spark.createDataFrame([("run-0", "id: x"), ("run-2", "id: y")], "run_id string, odcs_yaml string")
    got = runs.latest_contracts(listed, analysis)
    assert rows(got, "run_id", "file_name", "has_inline_yaml") == [
        ("run-1", "b.yaml", False),
        ("run-2", "demo.cuentas.odcs.yaml", True),
    ]
    assert runs.latest_contracts(listed, analysis, search="cuentas", scan=2).count() == 0
    assert runs.latest_contracts(listed, analysis, search="CUENTAS").count() == 1


def test_contract_documents_leave_out_empty_parts(spark):
    fields = spark.createDataFrame(
        [("s.t", 1, "id_cuenta", "D", "Cuenta", []), ("s.t", 2, "sld_actual", "T", "Saldo", []), ("s.t", 3, "cod_titular", "D", "T", [])],
        "table_name string, position bigint, field_name string, field_type string, description string, functions array<string>",
    )
    profile = spark.createDataFrame(
        [("s.t", "ID_CUENTA", "string", "VARCHAR", True, "ABC001")],
        "table_name string, field_name string, logical_type string, physical_type string, required boolean, example string",
    )
    ddl = spark.createDataFrame(
        [("s.t", "id_cuenta", "string", "STRING", False, False), ("s.t", "cod_titular", "string", "STRING", False, True)],
        "table_name string, field_name string, logical_type string, physical_type string, required boolean, partitioned boolean",
    )
    sample = spark.createDataFrame([("s.t", "sld_actual", "2421.12")], "table_name string, field_name string, example string")
    words = spark.createDataFrame(
        [("s.t", "id_cuenta", "Cuenta", "Numero de cuenta")],
        "table_name string, field_name string, business_name string, description string",
    )
    made = contracts.contract_fields(fields, profile, ddl, sample, words).orderBy("position")
    got = rows(made, "logical_type", "physical_type", "description", "required", "example", "partitioned", "business_name")
    assert got == [
        ("string", "STRING", "Numero de cuenta", True, "ABC001", False, "Cuenta"),
        ("string", None, "Saldo", False, "2421.12", False, "Sld Actual"),
        ("string", "STRING", "T", False, None, True, "Cod Titular"),
    ]
    products = spark.createDataFrame(
        [("s.t", "Cuentas", None, None, "diaria", None, "2026-05-12T00:00:00Z")],
        "table_name string, product string, domain string, purpose string, frequency string, granularity string, created string",
    )
    document = contracts.contract_documents(made, products).where("part = 'contract'").first()["body"]
    assert '"domain"' not in document and '"tags":["diaria"]' in document
    parts = contracts.contract_documents(made, products).collect()
    assert sorted((p["part"], p["position"], p["field_count"]) for p in parts if p["part"] == "contract") == [("contract", 0, 3)]
    properties = sorted((p["position"], p["body"]) for p in parts if p["part"] == "property")
    assert [at for at, _ in properties] == [1, 2, 3]
    assert [body.count('"partitionKeyPosition":1') for _, body in properties] == [0, 0, 1]


def test_table_names_match_by_tier(spark):
    catalogue = spark.createDataFrame(
        [(0, "main", "cd_cuentas"), (1, "demo", "otra")], "database_rank int, schema_name string, table_name string"
    )
    requests = spark.createDataFrame(
        [(1, 1, "demo.OTRA"), (2, 1, "x.CD-Cuentas"), (3, 1, "nada"), (4, 1, "demo.otra"), (4, 2, "cd_cuentas")],
        "request_id int, request_rank int, requested string",
    )
    got = contracts.matched_tables(requests, catalogue).orderBy("request_id")
    assert rows(got, "tier", "table_name") == [(1, "otra"), (3, "cd_cuentas"), (None, None), (1, "cd_cuentas")]


def test_ddl_and_dictionary_sidecars(spark):
    ddl = "CREATE TABLE ws.cd_t (\nid_cuenta STRING,\nsld DECIMAL(32, 2) NOT NULL\n)\nPARTITIONED BY (\ncod_titular STRING\n)\nSTORED AS PARQUET\n;"
    got = text.ddl_fields(spark.createDataFrame([("a", ddl)], "path string, text string"))
    assert sorted(rows(got, "field_name", "physical_type", "logical_type", "required", "partitioned")) == [
        ("cod_titular", "STRING", "string", False, True),
        ("id_cuenta", "STRING", "string", False, False),
        ("sld", "DECIMAL(32,2)", "number", True, False),
    ]
    words = "| Nombre | Descripcion |\n| --- | --- |\n| ID_Cuenta | Cuenta |\nlibre\n| sola |"
    got = text.dictionary_fields(spark.createDataFrame([("a", words)], "path string, text string"))
    assert rows(got, "field_name", "business_name", "description") == [("id_cuenta", "Id Cuenta", "Cuenta")]


def test_profile_takes_first_filled_value(spark):
    df = spark.createDataFrame([(k, None if k < 9 else f"v{k}") for k in range(20)], "k int, v string")
    got = tables.column_profile(df, ["k"]).orderBy("position")
    assert rows(got, "field_name", "logical_type", "example", "row_count", "null_count") == [
        ("k", "integer", "0", 20, 0),
        ("v", "string", "v9", 20, 9),
    ]


def test_folder_inventory_and_scripts(spark, tmp_path):
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "a.sql").write_text("select\n1")
    (tmp_path / "config.yml").write_text("x")
    got = text.folder_inventory(spark, str(tmp_path)).orderBy("relative_path")
    assert rows(got, "relative_path", "file_category", "size_bytes") == [
        ("config.yml", "config", 1),
        ("sql/a.sql", "sql", 8),
    ]
    assert rows(text.read_scripts(spark, str(tmp_path)), "text") == [("select\n1",)]


@pytest.mark.parametrize(
    "change,message",
    [
        ({"section_titles": ["x"]}, "Faltan secciones obligatorias"),
        ({"text": "SELECT a\nFROM b"}, "select from"),
        ({"text": "ver RN-09"}, "RN-09"),
        ({"file_name": "otro.docx"}, "debe iniciar con"),
        ({"unresolved": ["${x}"]}, "${x}"),
    ],
)
def test_audit_failures(spark, change, message):
    document = {
        "doc_id": 1,
        "document_kind": "step",
        "section_titles": audit.fixed.STEP_SECTIONS,
        "text": "Documento funcional sin codigo pegado.",
        "referenced_rule_ids": [],
        "file_name": "DA_REQ_CD_IT_demo.docx",
        "unresolved": [],
        "inferred": {},
    }
    schema = (
        "doc_id int, document_kind string, section_titles array<string>, text string, referenced_rule_ids array<string>, "
        "file_name string, unresolved array<string>, inferred map<string,string>"
    )
    fields = spark.createDataFrame([(1, "id_cliente")], "doc_id int, field_name string")
    rules = spark.createDataFrame([(1, "RN-01")], "doc_id int, rule_id string")

    def found(values):
        documents = spark.createDataFrame([tuple(values.values())], schema)
        found = audit.audit_findings(documents, fields, fields, fields, rules).where("item is not null")
        return [r["message"] + r["item"] for r in found.collect()]

    assert found(document) == []
    assert any(message in text for text in found({**document, **change}))


def test_markers_match_plain_search(spark):
    import re

    patterns = {
        "select from": r"\bselect\b.+\bfrom\b",
        "insert": r"\binsert\b",
        "join on": r"\bjoin\b.+\bon\b",
        "insert overwrite": r"\binsert\s+overwrite\b",
        "compute stats": r"\bcompute\s+stats\b",
        "variable sin resolver": r"\$\{[^}]+\}",
    }
    texts = [
        "Select x from", "selected from", "select", "selectfrom x from", "select from", "selecté from",
        "INSERT\n\noverwrite", "join a\ton", "join on", "ajoin b on join", "compute\x1cstats ${a b}", "${}", "on join",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: set(r["markers"]) for r in audit.marked_texts(df).collect()}
    for n, value in enumerate(texts):
        flat = " ".join(value.lower().split())
        assert got[n] == {label for label, pattern in patterns.items() if re.search(pattern, flat)}, value
    plan = audit.marked_texts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "regexp_replace" not in plan and "RLIKE" not in plan


def test_script_facts(spark):
    script = (
        "--| @NOMBRE: Carga\n--| @PROPOSITO:\n--|     # Saldos\n--drop table x; nada\n"
        "INSERT OVERWRITE TABLE ${esquema_cu}.cu_a\nSELECT * FROM rd.b JOIN rd.c ON 1=1 WHERE f = '${fec_ini_sem}' AND x = ${faltante};\n"
        "create table cd.d stored as parquet as\nselect * from ${esquema_cu}.cu_a;\nCOMPUTE STATS CD.D;"
    )
    reader = "insert overwrite table cd.e select * from cd.d"
    df = spark.createDataFrame([("a.sql", script), ("b.sql", reader)], "path string, text string")
    first = df.where("path = 'a.sql'")
    assert sorted(rows(scripts.variables(first), "token")) == [("${esquema_cu}",), ("${faltante}",), ("${fec_ini_sem}",)]
    known = spark.createDataFrame([("${esquema_cu}", "ws_cu")], "token string, value string")
    got = scripts.resolved_variables(first, known, {}, F.lit(date(2026, 5, 12)))
    assert sorted(rows(got, "token", "value", "status")) == [
        ("${esquema_cu}", "ws_cu", "configured"),
        ("${faltante}", None, "unresolved"),
        ("${fec_ini_sem}", "2026-05-12", "inferred"),
    ]
    assert sorted(rows(scripts.headers(first), "key", "value")) == [("NOMBRE", "Carga"), ("PROPOSITO", "Saldos")]
    assert rows(scripts.outputs(first), "table_name") == [("${esquema_cu}.cu_a",), ("cd.d",)]
    assert rows(scripts.publications(first), "sequence", "statement_type", "role", "has_compute_stats") == [
        (1, "insert_overwrite", "intermedia", False),
        (2, "create_table_as_select", "final", True),
    ]
    edges = set(rows(scripts.flow(df), "source_node", "target_node"))
    assert {("a.sql", "cd.d"), ("cd.d", "b.sql")} <= edges and not any("cd.e" in e for e in edges)


def test_rule_numbers_and_events(spark):
    facts = spark.createDataFrame([("r", n, f"d{n}", "Paso 4") for n in range(1, 13)], "run_id string, pos bigint, description string, step string")
    got = lineage.numbered_rules(facts.where("pos > 2"), facts.where("pos = 1"), facts.where("pos = 2"))
    by_id = {r["rule_id"]: (r["description"], r["applies_in"]) for r in got.collect()}
    assert by_id["RN-01"] == ("d3", "Paso 4") and by_id["RN-11"] == ("d1", "Paso 1") and by_id["RN-12"] == ("d2", "Paso 5")

    modules = spark.createDataFrame([("r", "m", "Modulo", "m.sql", "demo.t", "")], "run_id string, module_key string, module_name string, sql_file_name string, target_table string, resolved_sql string")
    sources = spark.createDataFrame([("r", "m", n, f"a.b{n}") for n in range(5)], "run_id string, module_key string, pos bigint, source_table string")
    edges = spark.createDataFrame([("r", "m", 90, "demo.t"), ("r", "m", 91, "demo.t")], "run_id string, module_key string, id bigint, target_node string")
    events = bundle.lineage_events(modules, sources, edges, "2026-05-12T00:00:00Z", "n").collect()
    inputs = sorted((e["position"], e["dataset"]["name"]) for e in events if e["part"] == "input")
    assert inputs == [(n, f"b{n}") for n in range(5)]
    assert [(e["position"], e["target"]) for e in events if e["part"] == "target"] == [(90, "demo.t")]
    assert [e["event"]["outputs"][0]["name"] for e in events if e["part"] == "event"] == ["t"]


def test_partition_publishing_replaces_only_touched_partitions(spark, tmp_path):
    table = "prueba_particiones"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    path = str(tmp_path / "t")
    tables.publish_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), table, ["p"], path)
    tables.publish_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), table, ["p"], path)
    assert sorted(rows(spark.table(table), "v", "p")) == [(1, "a"), (9, "b")]
    spark.sql(f"DROP TABLE {table}")


def test_error_counts_do_not_depend_on_the_number_of_items(spark):
    schema = (
        "doc_id int, document_kind string, section_titles array<string>, text string, referenced_rule_ids array<string>, "
        "file_name string, unresolved array<string>, inferred map<string,string>"
    )
    row = (1, "step", audit.fixed.STEP_SECTIONS, "texto", [], "DA_REQ_CD_IT_x.docx", [], {})
    documents = spark.createDataFrame([row], schema)
    none = spark.createDataFrame([], "doc_id int, field_name string")
    rules = spark.createDataFrame([], "doc_id int, rule_id string")
    for size in (1000, 1001):
        final = spark.range(size).selectExpr("1 AS doc_id", "concat('campo_', id) AS field_name")
        found = audit.audit_findings(documents, final, none, none, rules)
        assert audit.audit_summary(documents, found).first()["error_count"] == 2
        assert found.where("item is not null").count() == 2 * size
        assert {r["item_count"] for r in found.where("item is null").collect()} == {size}


def test_publications_in_all_spellings(spark):
    script = (
        "create table if not exists a.t1 as select 1; insert into a.t2 select 2; insert into table a.t3 select 3;"
        "insert overwrite a.t4 select 4; INSERT OVERWRITE TABLE a.t5 select 5; compute stats A.T3"
    )
    got = scripts.publications(spark.createDataFrame([("x.sql", script)], "path string, text string")).orderBy("sequence")
    assert rows(got, "target_table", "statement_type", "role", "has_compute_stats") == [
        ("a.t1", "create_table_as_select", "intermedia", False),
        ("a.t2", "insert_overwrite", "intermedia", False),
        ("a.t3", "insert_overwrite", "intermedia", True),
        ("a.t4", "insert_overwrite", "intermedia", False),
        ("a.t5", "insert_overwrite", "final", False),
    ]


def test_last_join_of_an_alias_tells_its_type(spark):
    modules = spark.createDataFrame([("r", "m", "cd.t", "select")], "run_id string, module_key string, target_table string, resolved_sql string")
    sources = spark.createDataFrame(
        [("r", "m", 1, "a", "rd.a"), ("r", "m", 2, "b", "rd.b")],
        "run_id string, module_key string, pos bigint, source_alias string, source_table string",
    )
    joins = spark.createDataFrame(
        [("r", "m", 1, "B", "left"), ("r", "m", 2, "b", "inner")],
        "run_id string, module_key string, pos bigint, source_alias string, join_type string",
    )
    fields = spark.createDataFrame([], "run_id string, module_key string, physical_source_fields array<string>")
    got = lineage.flow_edges(modules, sources, joins, fields)
    assert sorted(rows(got, "source_node", "relation_label")) == [("rd.a", "FROM / BASE"), ("rd.b", "INNER")]


def test_registry_keeps_sources_of_runs_without_target(spark):
    sources = spark.createDataFrame([("r", "rd.x", "table"), ("q", "rd.y", "view")], "run_id string, qualified_name string, source_kind string")
    targets = spark.createDataFrame([("r", "cd.t"), ("q", None)], "run_id string, target_table string")
    raw = spark.createDataFrame(
        [(1, "rd", "a", "TEMPORAL"), (2, " rd", "b", "RAW")], "fila int, esquema string, descripcion string, proposito string"
    )
    schemas = registry.schema_catalog(raw, "x.csv", order="fila")
    assert rows(schemas, "schema_name", "schema_type") == [("rd", "RAW")]
    got = registry.build_registry(sources, targets, schemas)
    assert sorted(rows(got, "run_id", "target_table", "source_schema_type")) == [("q", "", "RAW"), ("r", "cd.t", "RAW")]


def test_assets_say_what_contract_sources_and_files_say(spark):
    runs_ = spark.createDataFrame([("r", "demo.clientes"), ("q", "demo.otra"), ("p", "")], "run_id string, target_table string")
    contracts_ = spark.createDataFrame(
        [("r", "Clientes", "Clientes vigentes", ["captacion"]), ("q", "", None, None)],
        "run_id string, schema_name string, schema_description string, tags array<string>",
    )
    sources = spark.createDataFrame(
        [("r", 1, "raw.personas", "table", "Personas", "RAW"), ("r", 2, "raw.personas", "view", "otra", "STG"),
         ("r", 3, "suelta", "table", None, ""), ("r", 4, None, "table", "x", "RAW")],
        "run_id string, pos int, source_table string, source_kind string, contains_description string, layer string",
    )
    files = spark.createDataFrame(
        [("r", 1, "sql/a.sql", 5, "s3/a"), ("r", 2, "config.yml", 7, None), ("r", 3, "", 1, None)],
        "run_id string, pos int, relative_path string, size_bytes long, storage_path string",
    )
    found = bundle.assets(runs_, sources, files, contracts_)
    assert found.columns == ["run_id", *bundle.ASSET]
    got = {(r.run_id, r.qualified_name): tuple(r)[1:] for r in found.collect()}
    assert got == {
        ("r", "demo.clientes"): ("dataset", "demo.clientes", "Clientes", "Clientes vigentes", ["captacion"], "target", None, None, None, None),
        ("q", "demo.otra"): ("dataset", "demo.otra", "demo.otra", None, [], "target", None, None, None, None),
        ("r", "raw.personas"): ("dataset", "raw.personas", "personas", "Personas", ["RAW"], "source", "table", None, None, None),
        ("r", "suelta"): ("dataset", "suelta", "suelta", None, [], "source", "table", None, None, None),
        ("r", "sql/a.sql"): ("file", "sql/a.sql", "a.sql", None, [], "evidence", None, "sql", 5, "s3/a"),
        ("r", "config.yml"): ("file", "config.yml", "config.yml", None, [], "evidence", None, "config", 7, None),
    }
    plain = bundle.assets(runs_, sources.drop("layer", "contains_description"), files.drop("storage_path"))
    assert {r.display_name for r in plain.where("role = 'target'").collect()} == {"demo.clientes", "demo.otra"}
    fields = spark.createDataFrame([("r", 1, "a"), ("p", 1, "b")], "run_id string, position int, column string")
    assert [tuple(r) for r in bundle.asset_columns(found, fields).collect()] == [("r", "demo.clientes", 1, "a")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_of_a_node_move_once(spark):
    """The aggregate over whole edges and the window over nodes share one exchange, after all joins."""
    modules = spark.createDataFrame(
        [("r", "m", "cd.t", "select"), ("r", "n", "cd.u", "x union all y")], "run_id string, module_key string, target_table string, resolved_sql string"
    )
    sources = spark.createDataFrame(
        [("r", "m", 1, "a", "rd.a"), ("r", "m", 2, "a", "rd.a"), ("r", "n", 1, "b", "rd.b, rd.c"), (None, "n", 1, "b", "rd.z")],
        "run_id string, module_key string, pos bigint, source_alias string, source_table string",
    )
    joins = spark.createDataFrame([], "run_id string, module_key string, pos bigint, source_alias string, join_type string")
    fields = spark.createDataFrame(
        [("r", "m", ["rd.a.k", "rd.q.k", "rd.q.k"])], "run_id string, module_key string, physical_source_fields array<string>"
    )
    got = lineage.flow_edges(modules, sources, joins, fields)
    after = plan_of(got).split("Union")[0]
    assert after.count("Window") >= 1 and after.count("Exchange") == 1
    assert sorted(rows(got, "module_key", "source_node", "target_node", "relation_label")) == [
        ("m", "rd.a", "cd.t", "FROM / BASE"),
        ("m", "rd.a", "cd.t", "JOIN"),
        ("m", "rd.q", "cd.t", "LINEAGE"),
        ("n", "cd.u::union_all", "cd.u", "FROM / BASE"),
        ("n", "rd.b", "cd.u::union_all", "UNION ALL"),
        ("n", "rd.c", "cd.u::union_all", "UNION ALL"),
    ]


def test_contract_fields_are_joined_once(spark):
    fields = spark.createDataFrame(
        [("s.t", 1, "a"), ("s.t", 2, "a"), ("s.u", 1, "b"), (None, 1, "c")], "table_name string, position bigint, field_name string"
    )
    other = fields.select("table_name", F.lower("field_name").alias("field_name")).distinct().hint("merge")
    texts = ["logical_type", "physical_type", "description", "business_name", "classification", "example"]
    made = fields.join(other, ["table_name", "field_name"], "left").select(
        "*", *[F.lit("x").alias(name) for name in texts], F.lit(True).alias("required"), F.lit(False).alias("partitioned")
    )
    products = spark.createDataFrame(
        [("s.t", "P", "d", "p", "diaria", "g", "t")],
        "table_name string, product string, domain string, purpose string, frequency string, granularity string, created string",
    )
    got = contracts.contract_documents(made, products)
    assert "SortMergeJoin [table_name#" not in plan_of(got) or "LeftOuter" not in plan_of(got)
    assert sorted(rows(got, "table_name", "part", "position", "field_count"), key=str) == [
        ("s.t", "contract", 0, 2),
        ("s.t", "property", 1, None),
        ("s.t", "property", 2, None),
    ]


def test_ddl_fields_are_not_sorted_where_they_are_read(spark):
    """Nothing is grouped before the exchange, so a task that reads many texts holds none of their fields."""
    ddl = "CREATE TABLE a.b (\nx STRING,\ny INT\n)\nSTORED AS PARQUET;"
    texts = spark.createDataFrame([("p", ddl), ("p", ddl.replace("INT", "DATE NOT NULL")), ("q", ddl)], "path string, text string")
    got = text.ddl_fields(texts)
    before = plan_of(got).split("Exchange")
    assert len(before) == 2 and "Aggregate" not in before[1]
    assert sorted(rows(got, "path", "field_name", "physical_type")) [::3] == [("p", "x", "STRING"), ("q", "y", "INT")]
    assert got.count() == 4


def test_edges_are_put_together_where_their_module_is(spark):
    """Sources, joins and fields move once, together, and modules once: nothing moves again for aliases or nodes."""
    text = "run_id string, module_key string, "
    modules = spark.createDataFrame(
        [("r", "m", "cd.t", "select"), ("r", "m", "cd.v", None), ("r", "n", "cd.u", "Union All")], text + "target_table string, resolved_sql string"
    )
    sources = spark.createDataFrame(
        [("r", "m", 2, "A", "rd.a"), ("r", "m", 1, "z", "_tmp"), ("r", "m", 3, None, "rd.b"), ("r", "n", 4, "n", "rd.c, rd.d"),
         ("r", "n", None, "q", "rd.e"), ("r", "o", 1, "a", "rd.f"), (None, "m", 1, "a", "rd.g")],
        text + "pos bigint, source_alias string, source_table string",
    )
    joins = spark.createDataFrame(
        [("r", "m", 7, "a", "left"), ("r", "m", 8, "a", None), ("r", "m", None, "a", "full"), ("r", "m", 1, None, "cross"),
         ("r", "n", 1, "Q", "inner"), ("r", "n", 1, "a", "anti")],
        text + "pos bigint, source_alias string, join_type string",
    )
    fields = spark.createDataFrame(
        [("r", "m", ["rd.a.k", "cd.t.k", "rd.x.k", "rd.x.l", None]), ("r", "n", None), (None, "m", ["rd.y.k"])],
        text + "physical_source_fields array<string>",
    )
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        got = lineage.flow_edges(modules, sources, joins, fields)
        assert plan_of(got).count("Exchange") == 2
        found = rows(got, "module_key", "source_node", "target_node", "relation_label", "is_pivot")
    assert sorted(found) == [
        ("m", "_tmp", "cd.t", "FROM / BASE", True),
        ("m", "_tmp", "cd.v", "FROM / BASE", True),
        ("m", "cd.t", "cd.v", "LINEAGE", False),
        ("m", "rd.a", "cd.t", "JOIN", False),
        ("m", "rd.a", "cd.v", "JOIN", False),
        ("m", "rd.b", "cd.t", "JOIN", False),
        ("m", "rd.b", "cd.v", "JOIN", False),
        ("m", "rd.x", "cd.t", "LINEAGE", False),
        ("m", "rd.x", "cd.v", "LINEAGE", False),
        ("n", "cd.u::union_all", "cd.u", "FROM / BASE", True),
        ("n", "rd.c", "cd.u::union_all", "UNION ALL", False),
        ("n", "rd.d", "cd.u::union_all", "UNION ALL", False),
        ("n", "rd.e", "cd.u", "INNER", False),
    ]


def test_contract_fields_move_once_by_table(spark, monkeypatch):
    """Fields of products move by their table; neither the four joins nor the choice of products moves them again."""
    text = "table_name string, field_name string, "
    columns = spark.createDataFrame(
        [("s.t", "A", 1, "count"), ("s.t", "a", 2, "x"), ("s.u", "b", 1, "x"), (None, "c", 1, "x"), ("s.v", None, 1, "x")],
        text + "position bigint, f string",
    ).select("table_name", "position", "field_name", F.lit("T").alias("field_type"), F.lit("d").alias("description"), F.array("f").alias("functions"))
    profile = spark.createDataFrame(
        [("s.t", "A", "", "INT", True, "7"), (None, "c", "date", "DATE", True, "8")],
        text + "logical_type string, physical_type string, required boolean, example string",
    )
    ddl = spark.createDataFrame(
        [("s.t", "a", "integer", "BIGINT", False, True), ("s.u", "b", "date", "DATE", True, False)],
        text + "logical_type string, physical_type string, required boolean, partitioned boolean",
    )
    sample = spark.createDataFrame([("s.t", "a", "9"), ("s.t", "a", "10")], text + "example string")
    dictionary = spark.createDataFrame([("s.v", "x", "X", "dx")], text + "business_name string, description string")
    products = spark.createDataFrame(
        [(name, "P", "d", "p", "diaria", "g", "t") for name in ("s.t", "s.v", "s.v", "s.w", None)],
        "table_name string, product string, domain string, purpose string, frequency string, granularity string, created string",
    )
    plans, cut = [], contracts.cut
    monkeypatch.setattr(contracts, "cut", lambda df, name: plans.append(plan_of(df)) or cut(df, name))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        fields = contracts.contract_fields(contracts.of_products(columns, products), profile, ddl, sample, dictionary)
        got = contracts.contract_documents(fields, products)
    assert plans[0].count("LeftOuter") == 4 and plans[0].count("LeftSemi") == 2
    # One for the fields, one for each side and for either list of products.
    assert plans[0].count("Exchange") == 7 and "Exchange" not in plans[0].split("LeftOuter")[0]
    assert sorted(rows(got, "table_name", "part", "position", "field_count"), key=str) == [
        ("s.t", "contract", 0, 4),
        *[("s.t", "property", n, None) for n in (1, 1, 2, 2)],
        ("s.v", "contract", 0, 1),
        ("s.v", "contract", 0, 1),
        ("s.v", "property", 1, None),
    ]
    bodies = {r["body"] for r in got.where("part = 'property' AND table_name = 's.t'").collect()}
    assert len(bodies) == 2 and all('"logicalType":"integer"' in body and '"examples":["7"]' in body for body in bodies)
    found = {r["position"]: r["logical_type"] for r in contracts.contract_fields(columns, *[side.limit(0) for side in (profile, ddl, sample, dictionary)]).where("table_name = 's.t'").collect()}
    assert found == {1: "number", 2: "string"}
