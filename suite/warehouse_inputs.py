"""Bindings of the raw core-banking tables."""

from __future__ import annotations

from suite.lab import BINDINGS, PARAMS

SNAPSHOT = PARAMS.snapshot_number


def padded(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


def branch(key: str) -> str:
    return padded(f"{key} % 120", 4)


def service(key: str) -> str:
    return padded(f"{key} % 5 + 1", 2)


def number(key: str) -> str:
    return padded(key, 12)


def account(key: str) -> str:
    """Account id as the legacy core writes it."""
    return f"{branch(key)} || {service(key)} || {number(key)}"


def core_account(key: str) -> str:
    """Account id in the new core: migrated, masked, missing or new."""
    return (
        f"CASE WHEN {key} % 5 = 0 THEN {account(key)} WHEN {key} % 17 = 0 THEN 'XX' || {number(key)} "
        f"WHEN {key} % 19 = 0 THEN NULL ELSE '9' || {padded(key, 13)} END"
    )


def ymd(x: str) -> str:
    return f"(year({x}) * 10000 + month({x}) * 100 + day({x}))"


def customer(key: str) -> str:
    return padded(key, 8)


def cif(key: str) -> str:
    return f"'5' || {padded(key, 8)}"


def product_number(order: str, cust: str) -> str:
    return f"((1 + {order} % 25) * 10 + {cust} % 7)"


def price(x: str = "o_totalprice") -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


BINDINGS["accounts"] = lambda d: f"""
SELECT o_orderkey AS id_cuenta, o_custkey AS id_cliente, CAST(o_totalprice AS DECIMAL(32,2)) AS sld_actual,
       o_orderdate AS fec_apertura,
       CASE o_orderstatus WHEN 'F' THEN 'ACTIVA' WHEN 'O' THEN 'INACTIVA' ELSE 'CANCELADA' END AS cod_estatus
FROM {{orders}}"""

BINDINGS["clientes"] = lambda d: """
SELECT c_custkey AS cliente_id, r_name AS region, c_mktsegment AS segmento
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

BINDINGS["cuentas"] = lambda d: """
SELECT o_orderkey AS cuenta_id, o_custkey AS cliente_id, o_orderpriority AS producto,
       CASE o_orderstatus WHEN 'F' THEN 'Activa' WHEN 'O' THEN 'Bloqueada' ELSE 'Cancelada' END AS estatus,
       CAST(o_totalprice AS DECIMAL(18,2)) AS saldo_actual
FROM {orders}"""

BINDINGS["rd_pedt008"] = lambda d: f"""
SELECT {customer('o_custkey')} || CASE WHEN o_custkey % 10 = 0 THEN ' ' ELSE '' END AS num_cus,
       {branch('o_orderkey')} AS brn_open, '0127' AS cod_entity,
       CASE WHEN o_orderkey % 3 < 2 THEN 'T'
            ELSE substr('1234567ABCDEFGHKMOPRSTUVXYZQW', CAST(1 + o_orderkey % 29 AS INT), 1) || ' ' END AS key_partic,
       CAST(o_orderkey % 9 AS STRING) AS partseq,
       {service('o_orderkey')} AS cod_prodserv, {number('o_orderkey')} AS num_account,
       o_orderdate AS dat_reg,
       CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 90 DAY END AS dat_annulment
FROM {{orders}}"""

BINDINGS["rd_bgdt041"] = lambda d: f"""
SELECT '0127' AS t041_ent, {branch('o_orderkey')} AS t041_cen_reg,
       {service('o_orderkey')} || {number('o_orderkey')} AS t041_acc,
       {branch('last_branch')} AS t041_cen_acct, '01' AS t041_cod_product,
       {padded(product_number('o_orderkey', 'o_custkey'), 4)} AS t041_cod_sprod,
       CASE o_custkey % 3 WHEN 0 THEN '301' WHEN 1 THEN '721' ELSE '999' END AS t041_cod_rsnsubj,
       CASE WHEN o_custkey % 8 = 0 THEN 'USD' ELSE 'MXN' END AS t041_fcc,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'A' WHEN o_orderstatus = 'O' THEN 'I'
            ELSE substr('CPMZ', CAST(1 + o_orderkey % 4 AS INT), 1) END AS t041_flg_status,
       last_ship AS t041_dat_lastope, CAST(lines AS INT) AS t041_num_operation,
       {branch('last_part')} AS t041_cen_lastmod, 'U' || CAST(last_part AS STRING) AS t041_lastmoduser,
       CASE WHEN o_orderkey % 11 = 0 THEN 'S' WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'N' END AS t041_flg_blockcod,
       o_totalprice AS t041_wdrwbal
FROM {{orders}} JOIN (
  SELECT l_orderkey, max(l_shipdate) AS last_ship, count(*) AS lines, max(l_suppkey) AS last_branch,
         max(l_partkey) AS last_part
  FROM {{lineitem}} GROUP BY l_orderkey) AS moves ON l_orderkey = o_orderkey"""

BINDINGS["rd_bgdt006"] = lambda d: f"""
SELECT '0127' AS t006_ent, {branch('o_orderkey')} AS t006_cen_reg,
       {service('o_orderkey')} || {number('o_orderkey')} AS t006_acc,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate - INTERVAL 3 DAY END AS t006_dat_preopn,
       CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 30 DAY END AS t006_dat_can
FROM {{orders}} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"""

BINDINGS["rd_pedt065"] = lambda d: f"""
SELECT {customer('o_custkey')} AS t065_num_cus, CAST(o_custkey % 25 AS INT) AS t065_acc_country,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS t065_acc_channel, CAST(o_orderkey % 120 AS INT) AS t065_acc_brn,
       o_orderkey AS t065_acc_folio, o_orderdate AS t065_dat_reg,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END AS t065_stp_last_mod
FROM {{orders}}"""

BINDINGS["rd_mcdt403"] = lambda d: f"""
SELECT {customer('user_id')} AS t403_num_clte, 'ICU' || {padded('event_id', 10)} AS t403_bdmid,
       CASE WHEN event_id % 500 = 0 THEN NULL ELSE ts END AS t403_stp_ultmod
FROM {{events}}"""

BINDINGS["rd_tacuctefinacle"] = lambda d: f"""
SELECT CAST(c_custkey AS INT) AS fiid_cliente_unico, {cif('c_custkey')} AS fccliente_cif,
       DATE '1995-01-01' + CAST(c_custkey % 2000 AS INT) AS fdfecha_alta
FROM {{customer}}"""

BINDINGS["rd_cenconversion_clienteunico"] = lambda d: """
SELECT CASE WHEN o_orderkey % 41 = 0 THEN 'N/A' ELSE CAST(o_custkey AS STRING) END AS fiid_cliente_unico,
       CAST(o_custkey % 25 AS INT) AS fipais, CAST(substr(o_orderpriority, 1, 1) AS INT) AS ficanal,
       CAST(o_orderkey % 120 AS INT) AS fisucursal,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey END AS fifolio
FROM {orders}"""

BINDINGS["rd_cencuentaperson_clienteunico"] = lambda d: f"""
SELECT CAST(c_custkey AS INT) AS fiid_cliente_unico,
       {customer('c_custkey + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END')} AS fccliente_alnova,
       DATE '1996-01-01' + CAST(c_custkey % 900 AS INT) AS fdfecha_alta
FROM {{customer}} WHERE c_nationkey < 20"""

BINDINGS["cd_cte_master_diaria"] = lambda d: f"""
SELECT {customer('c_custkey')} AS id_cliente, 1000000 + c_custkey AS id_master, 'CLIENTE_ALNOVA' AS cod_tipo_cliente
FROM {{customer}} WHERE c_nationkey < 12
UNION ALL SELECT {customer('c_custkey')}, 5000000 + c_custkey, 'CLIENTE_ALNOVA' FROM {{customer}} WHERE c_nationkey < 6
UNION ALL SELECT {cif('c_custkey')}, 2000000 + c_custkey, 'CLIENTE_FINACLE' FROM {{customer}} WHERE c_nationkey BETWEEN 8 AND 18
UNION ALL SELECT CAST(o_custkey % 25 AS STRING) || '-' || substr(o_orderpriority, 1, 1) || '-' ||
                 CAST(o_orderkey % 120 AS STRING) || '-' || CAST(o_orderkey AS STRING),
                 3000000 + o_custkey, 'CLIENTE_UNICO' FROM {{orders}} WHERE o_orderstatus = 'F'
UNION ALL SELECT 'ICU' || {padded('event_id', 10)}, 4000000 + user_id, 'CLIENTE_ICU'
          FROM {{events}} WHERE event_type = 'click'"""

def _balances(d: type, aes: bool) -> str:
    return f"""
SELECT {d.protect(cif('o_custkey'), 'o_orderkey % 101 = 0', aes=aes)} AS identificadorcliente,
       {d.protect('(' + core_account('o_orderkey') + ')', aes=aes)} AS cuenta,
       {d.days('o_orderdate')} * 86400000 + 43200600 AS fechaapertura,
       CASE WHEN o_orderstatus = 'P' THEN {d.days('o_orderdate')} * 86400000 + 2592000000 END AS fechacancelacion,
       CAST(o_orderkey % 120 AS INT) AS centrocontable,
       {d.days('o_orderdate')} * 86400000 + 863999600 AS fechaultimomovimiento,
       CASE o_custkey % 3 WHEN 0 THEN '301' WHEN 1 THEN '721' ELSE '999' END AS personalidad,
       CASE o_orderstatus WHEN 'F' THEN 'A ' WHEN 'P' THEN 'C' ELSE 'I ' END AS estatuscuenta,
       CAST(1 + o_custkey % 2 AS INT) AS moneda,
       {d.protect(f"CAST({price()} AS STRING)", 'o_orderkey % 103 = 0', aes=aes)} AS saldototal,
       {d.protect(f"CAST(CAST({price()} - 150000 AS DECIMAL(18,2)) AS STRING)", 'o_orderkey % 107 = 0', aes=aes)} AS saldodisponible,
       CASE WHEN o_orderkey % 2 = 0 THEN 'PF' ELSE '01' END ||
         CAST({product_number('o_orderkey', 'o_custkey')} AS STRING) AS producto,
       CAST(o_orderkey % 360 AS INT) AS plazodeposito,
       CAST(CASE WHEN o_orderkey % 10 < 7 THEN {SNAPSHOT} ELSE {ymd('o_orderdate')} END AS INT) AS fifecha
FROM (SELECT * FROM {{orders}} UNION ALL SELECT * FROM {{orders}} WHERE o_orderpriority = '2-HIGH') AS loaded"""


BINDINGS["rd_fin_maestrosaldos"] = lambda d: _balances(d, aes=False)
BINDINGS["rd_fin_maestrosaldos_aes"] = lambda d: _balances(d, aes=True)

BINDINGS["rd_fin_cuentav2"] = lambda d: f"""
SELECT {d.protect('(' + core_account('l_orderkey') + ')')} AS numerocuenta,
       CAST(l_suppkey % 120 AS INT) AS sucursalapertura, CAST(l_partkey % 120 AS INT) AS sucursal,
       'U' || CAST(l_suppkey AS STRING) AS usuario,
       CASE l_returnflag WHEN 'R' THEN 'B' WHEN 'A' THEN ' ' END AS tipobloqueo,
       l_shipdate AS fechacambio, CAST({ymd('l_shipdate')} AS INT) AS fifecha
FROM {{lineitem}}"""

BINDINGS["rd_fin_990pf"] = lambda d: f"""
SELECT {d.protect('(' + core_account('l_orderkey') + ')')} AS cuenta FROM {{lineitem}}"""


def _catalogue(prefix: str) -> str:
    level = {
        1: "'Pasivo '",
        2: "' Vista'",
        3: "CASE WHEN kind < 4 THEN ' Captacion' WHEN kind = 4 THEN 'BIG ' ELSE 'Otro' END",
        4: "CASE brand % 6 WHEN 0 THEN 'Nomina ' WHEN 1 THEN 'Inversion' WHEN 2 THEN ' Ahorro' "
        "WHEN 3 THEN 'Colaboradores' WHEN 4 THEN 'Programas Sociales' ELSE 'Otro' END",
        5: "' N5 ' || CAST(least_size AS STRING)",
        6: "'N6 ' || CAST(parts AS STRING) || ' '",
        7: "'Plazo ' || CAST(brand AS STRING)",
    }
    levels = ", ".join(f"{text} AS fcnuevo_producto_nivel_0{n}" for n, text in level.items())
    return (
        f"SELECT ' {prefix}-' || {padded('brand * 10 + kind', 4)} AS fcproducto_subproducto, "
        f"' N' || CAST(kind AS STRING) AS fcnivel, {levels} FROM brands"
    )


BINDINGS["cu_ebx_catm_gs_productos_captacion_niveles"] = lambda d: f"""
WITH brands AS (
  SELECT CAST(substr(p_brand, 7, 4) AS INT) AS brand,
         CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3
                     WHEN 'LARGE' THEN 4 ELSE 5 END AS kind,
         min(p_size) AS least_size, count(*) AS parts
  FROM {{part}} GROUP BY 1, 2)
{_catalogue('01')} UNION ALL {_catalogue('PF')}"""


def _wide(prefix: str, where: str) -> str:
    day = (
        "CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN "
        "CAST(o_orderkey % 700 - {n} AS DECIMAL(18,2)) ELSE CAST({price} - {n} * 1000 AS DECIMAL(18,2)) END"
    )
    days = ", ".join(f"{day.format(n=n, price=price())} AS {prefix}_wdrwbal_{n:02d}" for n in range(1, 32))
    return f"""
SELECT {branch('o_orderkey')} AS {prefix}_cen_reg, {service('o_orderkey')} || {number('o_orderkey')} AS {prefix}_acc,
       CASE WHEN o_orderkey % 6 = 0 THEN '200106' ELSE '200107' END AS {prefix}_periodo, {days}
FROM {{orders}} WHERE {where}"""


BINDINGS["rd_bgdt503"] = lambda d: _wide("t503", "o_orderpriority <> '5-LOW'")
BINDINGS["rd_bgdt504"] = lambda d: _wide("t504", "o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')")

BINDINGS["rd_tcdt078"] = lambda d: f"""
SELECT {padded('s_suppkey', 4)} AS t078_centro_4, {padded('s_suppkey', 6)} AS t078_centro_6
FROM {{supplier}} WHERE s_nationkey < 15"""

BINDINGS["cu_portafolio_fenix_analitica_crm_historica"] = lambda d: f"""
SELECT {account('o_orderkey')} AS cuenta_alnova,
       CASE o_orderkey % 4 WHEN 0 THEN ' 0' WHEN 1 THEN 'n/d' ELSE ' ' || CAST(o_orderkey AS STRING) END AS id_empleado,
       ' REL ' || o_orderstatus AS tipo_relacion,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 120 AS STRING)
            ELSE {padded('o_orderkey % 120', 6)} END AS id_sucursal_asignada,
       CASE WHEN o_orderstatus = 'F' THEN 200129 ELSE 200128 END AS semanaproceso
FROM {{orders}} WHERE o_orderpriority <> '3-MEDIUM'"""
