"""Warehouse queries: customer links, account universe, portfolio, KPI cards, publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import columns as c
from ledgerloom.functions import fixed_values as fixed
from ledgerloom.operators.rows import argmin_concat
from ledgerloom.plans import accounts as acc
from ledgerloom.plans import identity, kpi, portfolio
from ledgerloom.session import cut, scratch_path
from ledgerloom.sources import tables
from suite import warehouse_inputs  # noqa: F401  (registers the bindings)
from suite.lab import AES_DECODER, CHECKS, DECODER, PARAMS, Lab

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(Lab(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def sql_case(value: str, labels: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN '{code}' THEN '{label}'" for code, label in labels.items())
    return f"CASE {value} {whens} ELSE {otherwise} END"


def sql_bands(value: str) -> str:
    whens = " ".join(f"WHEN {value} <= {bound} THEN '{label}'" for bound, label in fixed.BALANCE_BANDS)
    last = fixed.BALANCE_BANDS[-1][0]
    return f"CASE {whens} WHEN {value} > {last} THEN '{fixed.BALANCE_TOP}' ELSE '{fixed.BALANCE_NONE}' END"


AS_OF = f"DATE '{PARAMS.as_of.isoformat()}'"
NOW = f"TIMESTAMP '{PARAMS.as_of.isoformat()} 00:00:00'"
SNAP = f"DATE '{PARAMS.snapshot.isoformat()}'"


# ---------------------------------------------------------------- KPI cards and dashboard

YEAR_AGO = f"fec_apertura <= {AS_OF} - INTERVAL 1 YEAR"


def _card_sql(label: str, figure: str) -> str:
    return f"""
WITH f AS (SELECT ({figure.format(w='TRUE')}) AS a, ({figure.format(w=YEAR_AGO)}) AS b FROM {{accounts}})
SELECT '{label}' AS eje, CAST(round(a, 2) AS DECIMAL(38,2)) AS total_actual,
       CAST(round(b, 2) AS DECIMAL(38,2)) AS total_anterior,
       CAST(round(CAST(a - b AS DOUBLE) * 100 / nullif(CAST(b AS DOUBLE), 0), 2) AS DECIMAL(18,2)) AS variacion_pct
FROM f"""


@query("kpi_total_accounts", _card_sql("Total cuentas", "count(*) FILTER ({w})"))
def kpi_total_accounts(lab: Lab) -> DataFrame:
    return kpi.total_accounts(lab["accounts"], PARAMS)


@query("kpi_total_balance", _card_sql("Saldo total", "coalesce(sum(sld_actual) FILTER ({w}), 0)"))
def kpi_total_balance(lab: Lab) -> DataFrame:
    return kpi.total_balance(lab["accounts"], PARAMS)


@query(
    "kpi_avg_balance",
    _card_sql(
        "Saldo promedio",
        "coalesce(CAST(sum(sld_actual) FILTER ({w}) AS DOUBLE) / count(sld_actual) FILTER ({w}), 0)",
    ),
)
def kpi_avg_balance(lab: Lab) -> DataFrame:
    return kpi.average_balance(lab["accounts"], PARAMS)


@query(
    "dash_summary",
    """
SELECT c.region, c.segmento, count(DISTINCT c.cliente_id) AS clientes, count(DISTINCT a.cuenta_id) AS cuentas,
       CAST(count(*) FILTER (a.estatus = 'Activa') AS BIGINT) AS cuentas_activas,
       round(sum(a.saldo_actual), 2) AS saldo_total
FROM {clientes} c LEFT JOIN {cuentas} a ON a.cliente_id = c.cliente_id
GROUP BY ALL ORDER BY saldo_total DESC""",
)
def dash_summary(lab: Lab) -> DataFrame:
    view = f"v_dashboard_resumen_{uuid.uuid4().hex}"
    kpi.region_summary(lab["clientes"], lab["cuentas"]).createOrReplaceTempView(view)
    return lab.spark.table(view)


@query(
    "dash_top_accounts",
    """
SELECT a.cuenta_id, c.region, c.segmento, a.producto, a.estatus, a.saldo_actual
FROM {cuentas} a, {clientes} c WHERE a.cliente_id = c.cliente_id
ORDER BY a.saldo_actual DESC, a.cuenta_id LIMIT 10""",
)
def dash_top_accounts(lab: Lab) -> DataFrame:
    return kpi.top_accounts(lab["clientes"], lab["cuentas"])


@query(
    "inline_values_join",
    """
SELECT v.descripcion, count(*) AS cuentas, sum(a.saldo_actual) AS saldo
FROM {cuentas} a JOIN (VALUES ('Activa', 'en uso'), ('Bloqueada', 'detenida'), ('Cancelada', 'cerrada'))
  v(estatus, descripcion) ON v.estatus = a.estatus
GROUP BY v.descripcion""",
)
def inline_values_join(lab: Lab) -> DataFrame:
    labels = lab.spark.sql(
        "SELECT * FROM VALUES ('Activa', 'en uso'), ('Bloqueada', 'detenida'), ('Cancelada', 'cerrada') "
        "AS v(estatus, descripcion)"
    )
    totals = lab["cuentas"].groupBy("estatus").agg(F.count("*").alias("cuentas"), F.sum("saldo_actual").alias("saldo"))
    return totals.join(labels, "estatus").groupBy("descripcion").agg(
        F.sum("cuentas").alias("cuentas"), F.sum("saldo").cast("decimal(38,2)").alias("saldo")
    )


# ---------------------------------------------------------------- customer links

CHECKS["digital"] = """
SELECT t403_num_clte, arg_min(t403_bdmid, pos) AS icu FROM (
  SELECT *, row_number() OVER (PARTITION BY t403_num_clte
           ORDER BY t403_stp_ultmod DESC NULLS FIRST, t403_bdmid ASC NULLS LAST) AS pos FROM {rd_mcdt403})
GROUP BY t403_num_clte"""

CHECKS["link_core"] = f"""
SELECT alnova AS id_cliente_alnova, cif AS id_cliente_finacle, unico AS id_cliente_unico, icu AS id_icu_digital,
       conv AS id_conversion, stp AS fec_ult_mod_cte_unico, {NOW} AS fec_carga, 'FINACLE' AS cod_sistema
FROM (
  SELECT *, row_number() OVER (PARTITION BY cif ORDER BY
      filled DESC NULLS FIRST, (icu IS NOT NULL) DESC, agree DESC, since DESC NULLS FIRST,
      person_since DESC NULLS FIRST, stp DESC NULLS FIRST, unico NULLS LAST, alnova NULLS LAST,
      icu NULLS LAST, conv NULLS LAST) AS rn
  FROM (
    SELECT m.*, g.icu FROM (
      SELECT t0.fccliente_cif AS cif, t0.fiid_cliente_unico AS conv, t0.fdfecha_alta AS since,
             nullif(trim(concat_ws('-', CAST(t1.fipais AS STRING), CAST(t1.ficanal AS STRING),
                    CAST(t1.fisucursal AS STRING), CAST(t1.fifolio AS STRING))), '') AS unico,
             coalesce(t2.t065_num_cus, t3.fccliente_alnova) AS alnova,
             CAST(t1.fifolio IS NOT NULL AS INT) + CAST(t2.t065_num_cus IS NOT NULL AS INT) AS filled,
             coalesce(t3.fccliente_alnova = t2.t065_num_cus, FALSE) AS agree,
             t3.fdfecha_alta AS person_since, t2.t065_stp_last_mod AS stp
      FROM {{rd_tacuctefinacle}} t0
      LEFT JOIN {{rd_cenconversion_clienteunico}} t1 ON t0.fiid_cliente_unico = TRY_CAST(t1.fiid_cliente_unico AS INT)
      LEFT JOIN {{rd_pedt065}} t2 ON t2.t065_acc_country = t1.fipais AND t2.t065_acc_channel = t1.ficanal
           AND t2.t065_acc_brn = t1.fisucursal AND t2.t065_acc_folio = t1.fifolio
      LEFT JOIN {{rd_cencuentaperson_clienteunico}} t3 ON t3.fiid_cliente_unico = TRY_CAST(t1.fiid_cliente_unico AS INT)
    ) m LEFT JOIN {{digital}} g ON g.t403_num_clte = m.alnova)
) WHERE rn = 1"""


@query("link_core", "SELECT * FROM {link_core}")
def link_core(lab: Lab) -> DataFrame:
    return identity.core_links(lab, PARAMS)


CHECKS["least_core"] = """
SELECT id_cliente_alnova, min(id_cliente_finacle || '|' || CAST(id_conversion AS STRING)) AS pair
FROM {link_core} WHERE id_cliente_alnova IS NOT NULL GROUP BY id_cliente_alnova"""

CHECKS["link_legacy"] = f"""
SELECT p.num_cus AS id_cliente_alnova, split_part(f.pair, '|', 1) AS id_cliente_finacle,
       u.unico AS id_cliente_unico, d.icu AS id_icu_digital, CAST(split_part(f.pair, '|', 2) AS INT) AS id_conversion,
       u.stp AS fec_ult_mod_cte_unico, {NOW} AS fec_carga, 'ALNOVA' AS cod_sistema
FROM (SELECT DISTINCT num_cus FROM {{rd_pedt008}}) p
LEFT JOIN (
  SELECT t065_num_cus, t065_stp_last_mod AS stp,
         CAST(t065_acc_country AS STRING) || '-' || CAST(t065_acc_channel AS STRING) || '-' ||
         CAST(t065_acc_brn AS STRING) || '-' || CAST(t065_acc_folio AS STRING) AS unico
  FROM {{rd_pedt065}}
  QUALIFY row_number() OVER (PARTITION BY t065_num_cus
          ORDER BY t065_stp_last_mod DESC NULLS FIRST, t065_acc_folio ASC NULLS LAST) = 1
) u ON trim(u.t065_num_cus) = trim(p.num_cus)
LEFT JOIN {{digital}} d ON trim(d.t403_num_clte) = trim(p.num_cus)
LEFT JOIN {{least_core}} f ON trim(f.id_cliente_alnova) = trim(p.num_cus)"""


@query("link_legacy", "SELECT * FROM {link_legacy}")
def link_legacy(lab: Lab) -> DataFrame:
    return identity.legacy_links(lab, identity.core_links(lab, PARAMS), PARAMS)


CHECKS["link_union"] = f"""
SELECT coalesce(
         (SELECT min(id_master) FROM {{cd_cte_master_diaria}} m
           WHERE m.cod_tipo_cliente = 'CLIENTE_ALNOVA' AND m.id_cliente = l.id_cliente_alnova),
         (SELECT min(id_master) FROM {{cd_cte_master_diaria}} m
           WHERE m.cod_tipo_cliente = 'CLIENTE_FINACLE' AND m.id_cliente = l.id_cliente_finacle),
         (SELECT min(id_master) FROM {{cd_cte_master_diaria}} m
           WHERE m.cod_tipo_cliente = 'CLIENTE_UNICO' AND m.id_cliente = l.id_cliente_unico),
         (SELECT min(id_master) FROM {{cd_cte_master_diaria}} m
           WHERE m.cod_tipo_cliente = 'CLIENTE_ICU' AND m.id_cliente = l.id_icu_digital),
         CAST(-TRY_CAST(CASE WHEN cod_sistema = 'ALNOVA' THEN id_cliente_alnova ELSE id_cliente_finacle END AS INT)
              AS BIGINT)) AS id_master,
       id_cliente_alnova, id_cliente_finacle, id_cliente_unico, id_icu_digital, id_conversion,
       fec_ult_mod_cte_unico, {NOW} AS fec_carga, cod_sistema
FROM (SELECT * FROM {{link_core}} UNION ALL SELECT * FROM {{link_legacy}}) l"""


def _links(lab: Lab) -> DataFrame:
    core = cut(identity.core_links(lab, PARAMS), "core_links")
    return identity.customer_links(lab, core, identity.legacy_links(lab, core, PARAMS), PARAMS)


@query("link_union", "SELECT * FROM {link_union}")
def link_union(lab: Lab) -> DataFrame:
    return _links(lab)


@query(
    "argmin_concat",
    """
SELECT o_custkey, split_part(p, '|', 1) AS prioridad, TRY_CAST(split_part(p, '|', 2) AS INT) AS pedido FROM (
  SELECT o_custkey, min(o_orderpriority || '|' ||
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS STRING) END) AS p
  FROM {orders} GROUP BY o_custkey)""",
)
def argmin_per_customer(lab: Lab) -> DataFrame:
    rows = lab["orders"].select(
        "o_custkey",
        F.col("o_orderpriority").alias("prioridad"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("pedido"),
    )
    return argmin_concat(rows, "o_custkey", "prioridad", "pedido")


# ---------------------------------------------------------------- account universe

CHECKS["snapshot"] = f"""
SELECT DISTINCT identificadorcliente AS id_cliente, cuenta AS id_cuenta, fechaapertura, fechacancelacion,
       centrocontable, fechaultimomovimiento, personalidad, estatuscuenta, moneda, saldototal, saldodisponible,
       producto, plazodeposito
FROM {{rd_fin_maestrosaldos}}
WHERE try_strptime(trim(CAST(fifecha AS STRING)), '%Y%m%d') = {SNAP} AND NOT contains(lower(cuenta), 'x')"""


def _snapshot(lab: Lab) -> DataFrame:
    return acc.decoded_snapshot(lab, PARAMS, DECODER)


@query("snapshot_decode", "SELECT * FROM {snapshot}")
def snapshot_decode(lab: Lab) -> DataFrame:
    """The same snapshot from AES-encrypted columns."""
    encrypted = {"rd_fin_maestrosaldos": lab["rd_fin_maestrosaldos_aes"]}
    return acc.decoded_snapshot(encrypted, PARAMS, AES_DECODER).drop("cta_encrypt")


CHECKS["universe_legacy"] = f"""
SELECT h.num_cus AS id_cliente, h.brn_open AS id_sucursal_apertura, h.id_cuenta,
       coalesce(f.t006_dat_preopn, h.dat_reg) AS fec_apertura,
       coalesce(f.t006_dat_can, h.dat_annulment) AS fec_cancelacion,
       i.t041_cen_acct AS id_sucursal_gestora,
       concat_ws('-', i.t041_cod_product, i.t041_cod_sprod) AS cod_producto,
       i.t041_dat_lastope AS fec_ultima_txn, i.t041_num_operation AS num_ultima_txn,
       i.t041_cen_lastmod AS id_sucursal_ultima_txn, i.t041_lastmoduser AS cod_usuario_ultima_txn,
       CASE i.t041_flg_blockcod WHEN 'S' THEN 'BLOQUEADA' ELSE 'SIN BLOQUEO' END AS cod_bloqueo,
       {sql_case('trim(h.key_partic)', fixed.HOLDER_ROLES, 'h.key_partic || h.partseq')} AS desc_cod_titular,
       {sql_case('i.t041_cod_rsnsubj', fixed.PERSON_TYPES, "''")} AS cod_tipo_persona,
       {sql_case('i.t041_flg_status', fixed.LEGACY_STATUS, 'i.t041_flg_status')} AS cod_estatus,
       i.t041_fcc AS cod_tipo_moneda, CAST(i.t041_wdrwbal AS DECIMAL(32,2)) AS sld_actual,
       CAST(date_diff('day', CAST(i.t041_dat_lastope AS DATE), {AS_OF}) AS INT) AS num_dias_inactividad,
       '' AS plazodeposito,
       CAST(coalesce(f.t006_dat_preopn, h.dat_reg) >= {AS_OF} - INTERVAL 7 DAY
            AND coalesce(f.t006_dat_preopn, h.dat_reg) < {AS_OF} AS TINYINT) AS ind_cuenta_nueva,
       CAST(date_diff('day', CAST(coalesce(f.t006_dat_preopn, h.dat_reg) AS DATE), {AS_OF}) AS INT) AS num_dias_antiguedad,
       {NOW} AS fec_carga, 'ALNOVA' AS cod_sistema
FROM (SELECT *, cod_prodserv || num_account AS acc, brn_open || cod_prodserv || num_account AS id_cuenta
      FROM {{rd_pedt008}} WHERE CAST(dat_reg AS DATE) <= {SNAP}) h
JOIN {{rd_bgdt041}} i ON i.t041_ent = h.cod_entity AND i.t041_cen_reg = h.brn_open AND i.t041_acc = h.acc
LEFT JOIN {{rd_bgdt006}} f ON f.t006_ent = h.cod_entity AND f.t006_cen_reg = h.brn_open AND f.t006_acc = h.acc
WHERE NOT EXISTS (SELECT 1 FROM {{snapshot}} s WHERE s.id_cuenta = h.id_cuenta)"""


@query("universe_legacy", "SELECT * FROM {universe_legacy}")
def universe_legacy(lab: Lab) -> DataFrame:
    return acc.legacy_accounts(lab, _snapshot(lab), PARAMS)


def _ms(x: str) -> str:
    return f"make_timestamp(CAST(round({x} / 1000) AS BIGINT) * 1000000)"


CHECKS["universe_core"] = f"""
SELECT s.id_cliente, CAST(k.sucursalapertura AS STRING) AS id_sucursal_apertura, s.id_cuenta,
       CAST(CAST(opened AS DATE) AS TIMESTAMP) AS fec_apertura, {_ms('s.fechacancelacion')} AS fec_cancelacion,
       CAST(s.centrocontable AS STRING) AS id_sucursal_gestora,
       substr(s.producto, 1, 2) || '-' || lpad(substr(s.producto, 3), 4, '0') AS cod_producto,
       moved AS fec_ultima_txn, CAST(m.n AS INT) AS num_ultima_txn,
       CAST(k.sucursal AS STRING) AS id_sucursal_ultima_txn, k.usuario AS cod_usuario_ultima_txn,
       CASE WHEN coalesce(trim(k.tipobloqueo), '') = '' THEN 'SIN BLOQUEO' ELSE 'BLOQUEADA' END AS cod_bloqueo,
       'T-TITULAR' AS desc_cod_titular,
       {sql_case('s.personalidad', fixed.PERSON_TYPES, "''")} AS cod_tipo_persona,
       {sql_case('trim(s.estatuscuenta)', fixed.CORE_STATUS, 's.estatuscuenta')} AS cod_estatus,
       CAST(s.moneda AS STRING) AS cod_tipo_moneda, TRY_CAST(s.saldototal AS DECIMAL(32,2)) AS sld_actual,
       CAST(date_diff('day', CAST(moved AS DATE), {AS_OF}) AS INT) AS num_dias_inactividad,
       CAST(s.plazodeposito AS STRING) AS plazodeposito,
       CAST(opened >= {AS_OF} - INTERVAL 7 DAY AND opened < {AS_OF} AS TINYINT) AS ind_cuenta_nueva,
       CAST(date_diff('day', CAST(opened AS DATE), {AS_OF}) AS INT) AS num_dias_antiguedad,
       {NOW} AS fec_carga, 'FINACLE' AS cod_sistema
FROM (SELECT *, {_ms('fechaapertura')} AS opened, {_ms('fechaultimomovimiento')} AS moved FROM {{snapshot}}) s
LEFT JOIN (
  SELECT * FROM {{rd_fin_cuentav2}} WHERE try_strptime(CAST(fifecha AS STRING), '%Y%m%d') <= {SNAP}
  QUALIFY row_number() OVER (PARTITION BY numerocuenta ORDER BY fechacambio NULLS LAST, sucursalapertura NULLS LAST,
          sucursal NULLS LAST, usuario NULLS LAST, tipobloqueo NULLS LAST) = 1
) k ON k.numerocuenta = s.id_cuenta
LEFT JOIN (SELECT cuenta, count(*) AS n FROM {{rd_fin_990pf}} GROUP BY 1) m ON m.cuenta = s.id_cuenta"""


@query("universe_core", "SELECT * FROM {universe_core}")
def universe_core(lab: Lab) -> DataFrame:
    return acc.core_accounts(lab, _snapshot(lab), PARAMS)


CHECKS["universe"] = "SELECT * FROM {universe_legacy} UNION ALL SELECT * FROM {universe_core}"


class Published:
    """Datasets of one run, each written once to the shared folder before others read it."""

    def __init__(self, lab: Lab):
        self.lab = lab

    def build(self) -> Published:
        lab = self.lab
        self.links = cut(_links(lab), "links")
        self.snapshot = cut(_snapshot(lab), "snapshot")
        legacy = acc.legacy_accounts(lab, self.snapshot, PARAMS)
        core = acc.core_accounts(lab, self.snapshot, PARAMS)
        self.universe = cut(legacy.unionByName(core), "universe")
        return self

    def products(self) -> DataFrame:
        return acc.product_families(self.lab, self.universe, PARAMS)

    def balances(self) -> DataFrame:
        return portfolio.available_balances(
            self.universe, portfolio.period_balances(self.lab, PARAMS), self.snapshot, PARAMS
        )

    def assembled(self) -> DataFrame:
        return portfolio.assembled_portfolio(self.universe, self.links, self.products(), self.balances(), PARAMS)

    def active(self) -> DataFrame:
        return portfolio.active_portfolio(self.assembled(), PARAMS)


def _universe_only(lab: Lab) -> Published:
    run = Published(lab)
    run.snapshot = cut(_snapshot(lab), "snapshot")
    run.universe = acc.legacy_accounts(lab, run.snapshot, PARAMS).unionByName(
        acc.core_accounts(lab, run.snapshot, PARAMS)
    )
    return run


def _family_sql(level_3: str, level_4: str) -> str:
    whens = " ".join(
        f"WHEN trim({level_3}) = '{a}' AND trim({level_4}) = '{b}' THEN '{family}'"
        for (a, b), family in fixed.PRODUCT_FAMILIES.items()
    )
    return f"CASE {whens} ELSE '{fixed.OTHER_FAMILY}' END"


CHECKS["product_family"] = f"""
SELECT u.id_cuenta, trim(k.fcproducto_subproducto) AS cod_producto,
       {_family_sql('k.fcnuevo_producto_nivel_03', 'k.fcnuevo_producto_nivel_04')} AS cod_familia_producto,
       trim(k.fcnivel) AS cod_nivel_cuenta,
       {', '.join(f'trim(k.fcnuevo_producto_nivel_0{n}) AS cod_producto_nivel_0{n}' for n in range(1, 7))},
       CASE WHEN u.cod_producto IN ('PF-0022', 'PF-0002')
            THEN concat_ws(' ', k.fcnuevo_producto_nivel_07, u.plazodeposito, 'Dias')
            ELSE k.fcnuevo_producto_nivel_07 END AS cod_producto_nivel_07,
       u.cod_sistema, {NOW} AS fec_carga
FROM {{universe}} u
LEFT JOIN {{cu_ebx_catm_gs_productos_captacion_niveles}} k ON trim(k.fcproducto_subproducto) = trim(u.cod_producto)
WHERE u.desc_cod_titular = 'T-TITULAR'"""


@query("product_family", "SELECT * FROM {product_family}")
def product_family(lab: Lab) -> DataFrame:
    return _universe_only(lab).products()


DAY = PARAMS.balance_day
CHECKS["period_balances"] = f"""
SELECT t503_cen_reg || t503_acc AS id_cuenta, CAST(t503_wdrwbal_{DAY} AS DECIMAL(32,2)) AS sld_disponible,
       'ALNOVA' AS cod_sistema, {NOW} AS fec_carga
FROM {{rd_bgdt503}} WHERE t503_periodo = '{PARAMS.month_period}'
UNION ALL
SELECT t504_cen_reg || t504_acc, CAST(t504_wdrwbal_{DAY} AS DECIMAL(32,2)), 'ALNOVA', {NOW}
FROM {{rd_bgdt504}} WHERE t504_periodo = '{PARAMS.month_period}'"""


@query("wide_balance_pick", "SELECT * FROM {period_balances}")
def wide_balance_pick(lab: Lab) -> DataFrame:
    return portfolio.period_balances(lab, PARAMS)


CHECKS["available_balance"] = f"""
SELECT DISTINCT u.id_cuenta, b.amount AS sld_disponible, {sql_bands('b.amount')} AS cod_sld_disponible,
       u.cod_sistema, {NOW} AS fec_carga
FROM {{universe}} u LEFT JOIN (
  SELECT id_cuenta, amount FROM (
    SELECT id_cuenta, abs(sld_disponible) AS amount, cod_sistema FROM {{period_balances}}
    UNION ALL
    SELECT id_cuenta, abs(TRY_CAST(saldodisponible AS DECIMAL(32,2))), 'FINACLE' FROM {{snapshot}})
  QUALIFY row_number() OVER (PARTITION BY id_cuenta ORDER BY amount DESC NULLS FIRST, cod_sistema DESC) = 1
) b ON trim(b.id_cuenta) = trim(u.id_cuenta)"""


@query("available_balance", "SELECT * FROM {available_balance}")
def available_balance(lab: Lab) -> DataFrame:
    return _universe_only(lab).balances()


CHECKS["assembled"] = f"""
SELECT CASE u.cod_sistema WHEN 'ALNOVA' THEN u.id_cliente ELSE f.id_cliente_alnova END AS id_cliente_alnova,
       CASE u.cod_sistema WHEN 'FINACLE' THEN u.id_cliente ELSE a.id_cliente_finacle END AS id_cliente_finacle,
       coalesce(a.id_cliente_unico, f.id_cliente_unico) AS id_cliente_unico,
       coalesce(a.id_icu_digital, f.id_icu_digital) AS id_icu_digital,
       u.cod_tipo_persona, u.id_cuenta, u.id_sucursal_apertura, u.id_sucursal_gestora, u.desc_cod_titular,
       u.cod_estatus, u.fec_apertura, u.fec_cancelacion, u.cod_bloqueo, u.cod_tipo_moneda, u.fec_ultima_txn,
       u.id_sucursal_ultima_txn, u.cod_usuario_ultima_txn, u.num_ultima_txn, u.num_dias_inactividad,
       u.ind_cuenta_nueva, u.num_dias_antiguedad, p.cod_producto, p.cod_familia_producto, p.cod_nivel_cuenta,
       {', '.join(f'p.cod_producto_nivel_0{n}' for n in range(1, 8))},
       u.sld_actual, coalesce(b.sld_disponible, 0) AS sld_disponible, b.cod_sld_disponible,
       {NOW} AS fec_carga, u.cod_sistema
FROM {{universe}} u
LEFT JOIN {{link_union}} a ON a.id_cliente_alnova = u.id_cliente AND a.cod_sistema = u.cod_sistema
LEFT JOIN {{link_union}} f ON f.id_cliente_finacle = u.id_cliente AND f.cod_sistema = u.cod_sistema
LEFT JOIN {{product_family}} p ON p.cod_producto = u.cod_producto AND p.id_cuenta = u.id_cuenta
LEFT JOIN {{available_balance}} b ON b.id_cuenta = u.id_cuenta"""


@query("portfolio_assemble", "SELECT * FROM {assembled}")
def portfolio_assemble(lab: Lab) -> DataFrame:
    return Published(lab).build().assembled()


#: Buckets of the account tables; on a cluster as many as make a bucket one file.
BUCKETS = 8


def bucketed_portfolio(lab: Lab) -> DataFrame:
    """Linked universe, products and balances published in buckets of the account, and joined from there."""
    run = Published(lab).build()
    steps = {
        "linked": portfolio.with_links(run.universe, run.links),
        "products": run.products(),
        "balances": run.balances(),
    }
    read = {}
    for name, df in steps.items():
        table, path = _table_name(), scratch_path(lab.spark, name)
        tables.publish_bucketed(df, table, "id_cuenta", BUCKETS, path)
        read[name] = lab.spark.table(table)
    return portfolio.with_accounts(read["linked"], read["products"], read["balances"], PARAMS)


@query("portfolio_bucketed", "SELECT * FROM {assembled}")
def portfolio_bucketed(lab: Lab) -> DataFrame:
    """The assembled portfolio from bucketed tables: no row moves between the published steps."""
    return bucketed_portfolio(lab)


CHECKS["active"] = """
SELECT DISTINCT * EXCLUDE (fec_cancelacion), CASE desc_cod_titular WHEN 'T-TITULAR' THEN 'T' ELSE 'O' END AS cod_titular
FROM {assembled} WHERE cod_estatus <> 'CANCELADA'"""


@query("portfolio_active", "SELECT * FROM {active}")
def portfolio_active(lab: Lab) -> DataFrame:
    return Published(lab).build().active()


@query(
    "master_accounts",
    f"""
SELECT DISTINCT
       coalesce(a.id_master, f.id_master, -TRY_CAST(a.id_cliente_alnova AS BIGINT),
                -TRY_CAST(f.id_cliente_finacle AS BIGINT)) AS id_master,
       c.id_cliente_alnova, c.id_cliente_finacle, c.id_cliente_unico, c.id_icu_digital, c.cod_tipo_persona,
       c.cod_tipo_moneda, c.id_cuenta,
       coalesce(s2.t078_centro_6, c.id_sucursal_apertura) AS id_sucursal_apertura,
       coalesce(s3.t078_centro_6, c.id_sucursal_gestora) AS id_sucursal_gestora,
       c.desc_cod_titular, c.cod_estatus, c.fec_apertura,
       CAST(isoyear(c.fec_apertura) * 100 + weekofyear(c.fec_apertura) AS INT) AS num_sem_apertura,
       c.cod_bloqueo, c.fec_ultima_txn,
       coalesce(s4.t078_centro_6, c.id_sucursal_ultima_txn) AS id_sucursal_ultima_txn,
       c.cod_usuario_ultima_txn, c.num_ultima_txn,
       nullif(TRY_CAST(trim(v.id_empleado) AS INT), 0) AS id_empleado_portafolio,
       trim(v.tipo_relacion) AS cod_relacion_portafolio,
       coalesce(s1.t078_centro_6, v.branch) AS id_sucursal_portafolio,
       c.cod_producto, c.cod_nivel_cuenta, {', '.join(f'c.cod_producto_nivel_0{n}' for n in range(1, 8))},
       c.sld_actual, c.sld_disponible, c.cod_sld_disponible, c.fec_carga, c.cod_sistema,
       {PARAMS.week_period} AS num_periodo_sem, c.cod_titular
FROM {{active}} c
LEFT JOIN (SELECT *, CASE WHEN length(id_sucursal_asignada) < 4 THEN lpad(id_sucursal_asignada, 4, '0')
                          ELSE id_sucursal_asignada END AS branch
           FROM {{cu_portafolio_fenix_analitica_crm_historica}}
           WHERE semanaproceso = {PARAMS.advisor_period}) v ON v.cuenta_alnova = c.id_cuenta
LEFT JOIN {{rd_tcdt078}} s1 ON s1.t078_centro_4 = v.branch
LEFT JOIN {{rd_tcdt078}} s2 ON s2.t078_centro_4 = c.id_sucursal_apertura
LEFT JOIN {{rd_tcdt078}} s3 ON s3.t078_centro_4 = c.id_sucursal_gestora
LEFT JOIN {{rd_tcdt078}} s4 ON s4.t078_centro_4 = c.id_sucursal_ultima_txn
LEFT JOIN {{link_union}} a ON a.id_cliente_alnova = c.id_cliente_alnova AND a.cod_sistema = 'ALNOVA'
LEFT JOIN {{link_union}} f ON f.id_cliente_finacle = c.id_cliente_finacle AND f.cod_sistema = 'FINACLE'""",
)
def master_accounts(lab: Lab) -> DataFrame:
    run = Published(lab).build()
    return portfolio.account_master(lab, cut(run.active(), "active"), run.links, PARAMS)


# ---------------------------------------------------------------- scalar rules on whole tables


@query(
    "decode_role",
    f"""
SELECT num_cus, num_account, {sql_case('trim(key_partic)', fixed.HOLDER_ROLES, 'key_partic || partseq')} AS rol,
       CASE WHEN trim(key_partic) = 'T' THEN 'T' ELSE 'O' END AS cod_titular
FROM {{rd_pedt008}}""",
)
def decode_role(lab: Lab) -> DataFrame:
    return lab["rd_pedt008"].select(
        "num_cus",
        "num_account",
        c.holder_role(F.col("key_partic"), F.col("partseq")).alias("rol"),
        F.when(F.trim("key_partic") == "T", "T").otherwise("O").alias("cod_titular"),
    )


@query(
    "balance_bucket",
    f"""
WITH b AS (SELECT c_custkey AS id, CAST(c_acctbal AS DECIMAL(32,2)) AS saldo FROM {{customer}}
           UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL
                  ELSE CAST(o_totalprice AS DECIMAL(32,2)) END FROM {{orders}}
           UNION ALL SELECT p_partkey, CAST(p_size AS DECIMAL(32,2)) FROM {{part}})
SELECT {sql_bands('saldo')} AS rango, count(*) AS cuentas, sum(saldo) AS saldo FROM b GROUP BY 1""",
)
def balance_bucket(lab: Lab) -> DataFrame:
    rows = (
        lab["customer"]
        .select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast(c.MONEY).alias("saldo"))
        .unionAll(
            lab["orders"].select(
                "o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice").cast(c.MONEY))
            )
        )
        .unionAll(lab["part"].select("p_partkey", F.col("p_size").cast(c.MONEY)))
    )
    return rows.groupBy(c.balance_band(F.col("saldo")).alias("rango")).agg(
        F.count("*").alias("cuentas"), F.sum("saldo").cast("decimal(38,2)").alias("saldo")
    )


@query(
    "iso_week_code",
    """
SELECT CAST(isoyear(o_orderdate) * 100 + weekofyear(o_orderdate) AS INT) AS semana, count(*) AS cuentas
FROM {orders} GROUP BY 1""",
)
def iso_week_code(lab: Lab) -> DataFrame:
    week = c.iso_week_code(F.col("o_orderdate").cast("date"))
    return lab["orders"].groupBy(week.alias("semana")).agg(F.count("*").alias("cuentas"))


@query(
    "scalar_functions",
    f"""
SELECT o_orderkey,
       concat_ws('-', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END) AS unido,
       nullif(trim(concat_ws('-', CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END)), '') AS vacio_nulo,
       nullif(TRY_CAST(substr(o_orderpriority, 1, CAST(1 + o_orderkey % 2 AS INT)) AS INT) % 5, 0) AS sin_cero,
       -TRY_CAST(CAST(o_custkey AS STRING) AS BIGINT) AS id_negativo,
       CASE WHEN length(CAST(o_custkey AS STRING)) < 4 THEN lpad(CAST(o_custkey AS STRING), 4, '0')
            ELSE CAST(o_custkey AS STRING) END AS sucursal,
       substr('PF' || CAST(o_custkey AS STRING), 1, 2) || '-' ||
         lpad(substr('PF' || CAST(o_custkey AS STRING), 3), 4, '0') AS producto,
       make_timestamp(CAST(round((o_orderkey * 86400000 + 43200600) / 1000) AS BIGINT) * 1000000) AS momento,
       CAST(try_strptime(CAST(19950000 + o_orderkey % 1300 AS STRING), '%Y%m%d') AS DATE) AS fecha,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), {AS_OF}) AS INT) AS dias,
       CAST(o_orderdate >= {AS_OF} - INTERVAL 7 DAY AND o_orderdate < {AS_OF} AS INT) AS nueva,
       o_orderdate <= {AS_OF} - INTERVAL 1 YEAR AS hace_un_anio,
       abs(CAST(o_totalprice - 200000 AS DECIMAL(32,2))) AS saldo
FROM {{orders}}""",
)
def scalar_functions(lab: Lab) -> DataFrame:
    order = F.col("o_orderkey")
    code = F.concat(F.lit("PF"), F.col("o_custkey").cast("string"))
    head = F.col("o_orderpriority").substr(F.lit(1), (1 + order % 2).cast("int"))
    opened = F.col("o_orderdate")
    return lab["orders"].select(
        "o_orderkey",
        F.concat_ws("-", "o_orderstatus", F.when(order % 2 == 0, F.col("o_orderpriority"))).alias("unido"),
        c.dash_id(F.when(order % 3 > 0, F.col("o_orderstatus"))).alias("vacio_nulo"),
        F.nullif(head.try_cast("int") % 5, F.lit(0)).alias("sin_cero"),
        c.negative_id(F.col("o_custkey").cast("string"), "bigint").alias("id_negativo"),
        c.padded_branch(F.col("o_custkey").cast("string")).alias("sucursal"),
        c.rebuilt_product(code).alias("producto"),
        c.epoch_ms(order * 86400000 + 43200600).alias("momento"),
        c.day_number(19950000 + order % 1300).alias("fecha"),
        F.datediff(PARAMS.today, opened.cast("date")).alias("dias"),
        F.when((opened >= PARAMS.new_account_floor) & (opened < PARAMS.now), 1).otherwise(0).alias("nueva"),
        (opened <= (PARAMS.today - F.expr("INTERVAL 1 YEAR")).cast("timestamp_ntz")).alias("hace_un_anio"),
        F.abs((F.col("o_totalprice") - 200000).cast(c.MONEY)).alias("saldo"),
    )


@query(
    "union_distinct",
    "SELECT c_nationkey AS nacion FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
)
def union_distinct(lab: Lab) -> DataFrame:
    return (
        lab["customer"]
        .select(F.col("c_nationkey").alias("nacion"))
        .union(lab["supplier"].select("s_nationkey"))
        .distinct()
    )


# ---------------------------------------------------------------- publishing

PUBLISHED = ["id_cuenta", "id_cliente", "sld_actual", "cod_estatus"]


def _table_name() -> str:
    return f"ledgerloom_{uuid.uuid4().hex}"


def _read_back(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The published files; the catalogue entry is dropped, the external files stay."""
    schema = spark.table(table).schema
    spark.sql(f"DROP TABLE {table}")
    return spark.read.schema(schema).parquet(path)


@query("publish_overwrite", "SELECT id_cuenta, id_cliente, sld_actual, cod_estatus FROM {accounts}")
def publish_overwrite(lab: Lab) -> DataFrame:
    table, path = _table_name(), scratch_path(lab.spark, "overwrite")
    rows = lab["accounts"].select(*PUBLISHED)
    tables.publish_overwrite(rows.where("cod_estatus = 'ACTIVA'"), table, path)
    tables.publish_overwrite(rows, table, path)
    return _read_back(lab.spark, table, path)


@query("publish_ctas", "SELECT id_cuenta, id_cliente, sld_actual, cod_estatus FROM {accounts}")
def publish_ctas(lab: Lab) -> DataFrame:
    table, path = _table_name(), scratch_path(lab.spark, "ctas")
    tables.publish_ctas(lab["accounts"].select(*PUBLISHED), table, path)
    return _read_back(lab.spark, table, path)


@query(
    "publish_dynamic_partition",
    """
SELECT id_cuenta, id_cliente, CASE cod_estatus WHEN 'INACTIVA' THEN CAST(sld_actual * 2 AS DECIMAL(32,2)) ELSE sld_actual END AS sld_actual,
       cod_estatus
FROM {accounts}""",
)
def publish_dynamic_partition(lab: Lab) -> DataFrame:
    """First all statuses, then a second run for one status that must leave the others alone."""
    table, path = _table_name(), scratch_path(lab.spark, "partitions")
    rows = lab["accounts"].select(*PUBLISHED)
    tables.publish_partitions(rows, table, ["cod_estatus"], path)
    again = rows.where("cod_estatus = 'INACTIVA'").withColumn(
        "sld_actual", (F.col("sld_actual") * 2).cast(c.MONEY)
    )
    tables.publish_partitions(again, table, ["cod_estatus"], path)
    return _read_back(lab.spark, table, path)


@query(
    "param_report",
    """
SELECT c.segmento, c.region, count(*) AS cuentas, CAST(sum(a.saldo_actual) AS DECIMAL(38,2)) AS saldo
FROM {cuentas} a JOIN {clientes} c ON c.cliente_id = a.cliente_id GROUP BY ALL""",
)
def param_report(lab: Lab) -> DataFrame:
    """A saved query written as one CSV folder per segment, read back."""
    path = scratch_path(lab.spark, "report")
    held = lab["cuentas"].groupBy("cliente_id").agg(F.count("*").alias("cuentas"), F.sum("saldo_actual").alias("saldo"))
    rows = (
        held.join(lab["clientes"], "cliente_id")
        .groupBy("segmento", "region")
        .agg(F.sum("cuentas").alias("cuentas"), F.sum("saldo").cast("decimal(38,2)").alias("saldo"))
    )
    tables.write_report(rows, "segmento", path)
    schema = "region string, cuentas bigint, saldo decimal(38,2), segmento string"
    return lab.spark.read.schema(schema).option("header", True).csv(path)
