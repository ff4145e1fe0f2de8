"""The account joins of the portfolio: how often wide rows move, and NULL or repeated keys."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import accounts, portfolio
from ledgerloom.session import setting
from suite.lab import PARAMS

LINKS = "id_master bigint, id_cliente_alnova string, id_cliente_finacle string, cod_sistema string"
ADVISORS = "cuenta_alnova string, id_empleado string, tipo_relacion string, id_sucursal_asignada string, semanaproceso int"


def moves(spark, df, column):
    """The number of shuffles that carry a column."""
    with setting(spark, "spark.sql.debug.maxToStringFields", "500"), io.StringIO() as text, redirect_stdout(text):
        df.explain("formatted")
        plan = text.getvalue()
    return len(re.findall(rf"\) Exchange[^\n]*\nInput [^\n]*\b{column}#", plan))


@pytest.fixture
def joins(spark):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), setting(spark, "spark.sql.adaptive.enabled", "false"):
        yield spark


def universe(spark, rows):
    names = [name for name, _ in accounts.UNIVERSE]
    given = spark.createDataFrame(rows, "id_cuenta string, id_cliente string, cod_sistema string, cod_producto string, sld_actual int")
    kinds = dict(accounts.UNIVERSE)
    return given.select(
        *[(F.col(n) if n in given.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names],
        *[F.lit(None).cast("string").alias(n) for n in ("_legacy_core", "_legacy_unique", "_legacy_digital")],
        *[F.lit(None).cast("string").alias(n) for n in ("_core_legacy", "_core_unique", "_core_digital")],
    )


def test_products_and_balances_move_the_universe_once(joins):
    rows = [("a", "c1", "ALNOVA", "p", 1), ("a", "c2", "ALNOVA", "q", 2), (None, "c3", "FINACLE", "p", 3), ("b", "c1", "ALNOVA", None, 4)]
    products = joins.createDataFrame([("a", "p", "x"), ("a", "p", "y"), ("b", None, "z"), (None, "p", "n")], "id_cuenta string, cod_producto string, cod_familia_producto string")
    products = products.select("*", *[F.lit("-").alias(n) for n in portfolio.ATTRIBUTES[1:]])
    balances = joins.createDataFrame([("a", 7), ("b", 8)], "id_cuenta string, sld int").select(
        "id_cuenta", F.col("sld").cast("decimal(32,2)").alias("sld_disponible"), F.lit("B").alias("cod_sld_disponible")
    )
    out = portfolio.with_accounts(universe(joins, rows), products, balances, PARAMS)
    assert moves(joins, out, "sld_actual") == 1
    found = {(r["id_cuenta"], int(r["sld_actual"]), r["cod_producto"], r["cod_familia_producto"], int(r["sld_disponible"])) for r in out.collect()}
    assert found == {("a", 1, "p", "x", 7), ("a", 1, "p", "y", 7), ("a", 2, None, None, 7), (None, 3, None, None, 0), ("b", 4, None, None, 8)}


def test_master_ids_move_the_portfolio_once(joins):
    names = [
        "id_cliente_unico", "id_icu_digital", "cod_tipo_persona", "cod_tipo_moneda", "id_sucursal_apertura",
        "id_sucursal_gestora", "desc_cod_titular", "cod_estatus", "fec_apertura", "cod_bloqueo", "fec_ultima_txn",
        "id_sucursal_ultima_txn", "cod_usuario_ultima_txn", "num_ultima_txn", "cod_producto", "cod_nivel_cuenta",
        *[f"cod_producto_nivel_0{n}" for n in range(1, 8)], "sld_disponible", "cod_sld_disponible", "fec_carga",
    ]
    rows = [("a", "1", None, 10), ("a", "1", None, 11), ("a", "1", None, 11), ("a", None, "9", 12), (None, "1", "9", 13), (None, None, None, 14), ("b", "7", "8", 15)]
    given = joins.createDataFrame(rows, "id_cuenta string, id_cliente_alnova string, id_cliente_finacle string, sld_actual int")
    rows = given.select("*", *[F.lit(None).cast("string").alias(n) for n in names], F.lit("S").alias("cod_sistema"))
    links = joins.createDataFrame(
        [(100, "1", None, "ALNOVA"), (101, "1", None, "ALNOVA"), (900, None, "9", "FINACLE"), (None, "7", None, "ALNOVA"), (5, "1", None, "FINACLE")],
        LINKS,
    )
    tables = {
        "cu_portafolio_fenix_analitica_crm_historica": joins.createDataFrame(
            [("a", " 3", " r ", "12", PARAMS.advisor_period), ("a", " 3", " r ", "12", PARAMS.advisor_period), ("b", "n/d", "s", "5", 1)], ADVISORS
        ),
        "rd_tcdt078": joins.createDataFrame([("0012", "000012")], "t078_centro_4 string, t078_centro_6 string"),
    }
    out = portfolio.account_master(tables, rows, links, PARAMS)
    assert moves(joins, out, "sld_actual") == 1
    found = sorted((r["sld_actual"], r["id_master"], r["id_empleado_portafolio"], r["id_sucursal_portafolio"]) for r in out.collect() if r["id_master"])
    branch = (3, "000012")
    assert found == [
        (10, 100, *branch), (10, 101, *branch), (11, 100, *branch), (11, 101, *branch), (12, 900, *branch),
        (13, 100, None, None), (13, 101, None, None), (15, -7, None, None),
    ]
    assert [r["sld_actual"] for r in out.where("id_master is null").collect()] == [14]
