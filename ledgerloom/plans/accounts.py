"""The account universe: decoded snapshot, legacy accounts, new-core accounts, products."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import fixed_values as fixed
from ledgerloom.functions.columns import (
    MONEY,
    Decoder,
    day_number,
    decode,
    epoch_ms,
    holder_role,
    oldest,
    person_type,
    product_family,
    rebuilt_product,
)
from ledgerloom.operators.decoding import decode_dictionary, with_decoded
from ledgerloom.operators.rows import best_by
from ledgerloom.params import Params
from ledgerloom.session import cut

Tables = Mapping[str, DataFrame]

# Columns of the account universe. Both branches are cast to these types.
UNIVERSE = [
    ("id_cliente", "string"),
    ("id_sucursal_apertura", "string"),
    ("id_cuenta", "string"),
    ("fec_apertura", "timestamp_ntz"),
    ("fec_cancelacion", "timestamp_ntz"),
    ("id_sucursal_gestora", "string"),
    ("cod_producto", "string"),
    ("fec_ultima_txn", "timestamp_ntz"),
    ("num_ultima_txn", "int"),
    ("id_sucursal_ultima_txn", "string"),
    ("cod_usuario_ultima_txn", "string"),
    ("cod_bloqueo", "string"),
    ("desc_cod_titular", "string"),
    ("cod_tipo_persona", "string"),
    ("cod_estatus", "string"),
    ("cod_tipo_moneda", "string"),
    ("sld_actual", MONEY),
    ("num_dias_inactividad", "int"),
    ("plazodeposito", "string"),
    ("ind_cuenta_nueva", "tinyint"),
    ("num_dias_antiguedad", "int"),
    ("fec_carga", "timestamp_ntz"),
    ("cod_sistema", "string"),
]


def _universe(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    return df.select(*[values[name].cast(kind).alias(name) for name, kind in UNIVERSE])


def _on_day(df: DataFrame, name: str, params: Params, up_to: bool) -> Column:
    """Day filter on a ``yyyyMMdd`` column. Numeric columns are compared raw, so Parquet can skip row groups."""
    parsed = day_number(F.col(name))
    if not isinstance(df.schema[name].dataType, T.IntegralType):
        return parsed <= params.snapshot_day if up_to else parsed == params.snapshot_day
    if up_to:
        return (F.col(name) <= params.snapshot_number) & (parsed <= params.snapshot_day)
    return F.col(name) == params.snapshot_number


def _is_new(opened: Column, params: Params) -> Column:
    return F.when((opened >= params.new_account_floor) & (opened < params.now), 1).otherwise(0)


def _days_since(moment: Column, params: Params) -> Column:
    return F.datediff(params.today, moment.cast("date"))


def decoded_snapshot(tables: Tables, params: Params, decoder: Decoder) -> DataFrame:
    """One snapshot day of the new core with its four protected columns decoded.

    Rows whose account is still masked (holds an ``x``) or missing are dropped. Each distinct stored value of a column is
    decoded once, into a written dictionary that the distinct stored rows are joined with. A last pass removes rows that only
    decode equally.
    """
    raw = tables["rd_fin_maestrosaldos"]
    table = "rd_fin_maestrosaldos"
    plain = [
        "fechaapertura",
        "fechacancelacion",
        "centrocontable",
        "fechaultimomovimiento",
        "personalidad",
        "estatuscuenta",
        "moneda",
        "producto",
        "plazodeposito",
    ]
    protected = ["identificadorcliente", "cuenta", "saldototal", "saldodisponible"]
    day = raw.where(_on_day(raw, "fifecha", params, up_to=False)).select(*protected, *plain)

    stored = cut(day.distinct(), "stored_rows")
    dictionary = decode_dictionary(stored, table, protected, decoder, params.decode_error)
    # The account comes last: rows equal in all columns then lie together already.
    decoded = with_decoded(stored.where("cuenta is not null"), dictionary, [*[n for n in protected if n != "cuenta"], "cuenta"])
    decoded = decoded.where(~F.lower("clear_cuenta").like("%x%"))
    return decoded.select(
        F.col("clear_identificadorcliente").alias("id_cliente"),
        F.col("clear_cuenta").alias("id_cuenta"),
        F.col("cuenta").alias("cta_encrypt"),
        *plain[:7],
        F.col("clear_saldototal").alias("saldototal"),
        F.col("clear_saldodisponible").alias("saldodisponible"),
        *plain[7:],
    ).distinct()


def legacy_accounts(tables: Tables, snapshot: DataFrame, params: Params) -> DataFrame:
    """Legacy accounts not yet in the new core, with status, role, age and inactivity."""
    next_day = F.lit((params.snapshot + timedelta(days=1)).isoformat()).cast("timestamp_ntz")
    holders = (
        tables["rd_pedt008"]
        .where(F.col("dat_reg") < next_day)
        .select(
            "num_cus",
            "brn_open",
            "cod_entity",
            "key_partic",
            "partseq",
            F.concat("cod_prodserv", "num_account").alias("acc"),
            "dat_reg",
            "dat_annulment",
        )
        .withColumn("id_cuenta", F.concat("brn_open", "acc"))
        .join(snapshot.select("id_cuenta"), "id_cuenta", "left_anti")
    )
    keys = ["cod_entity", "brn_open", "acc"]
    master = tables["rd_bgdt041"].select(
        F.col("t041_ent").alias("cod_entity"),
        F.col("t041_cen_reg").alias("brn_open"),
        F.col("t041_acc").alias("acc"),
        "t041_cen_acct",
        "t041_cod_product",
        "t041_cod_sprod",
        "t041_cod_rsnsubj",
        "t041_fcc",
        "t041_flg_status",
        "t041_dat_lastope",
        "t041_num_operation",
        "t041_cen_lastmod",
        "t041_lastmoduser",
        "t041_flg_blockcod",
        "t041_wdrwbal",
    )
    dates = tables["rd_bgdt006"].select(
        F.col("t006_ent").alias("cod_entity"),
        F.col("t006_cen_reg").alias("brn_open"),
        F.col("t006_acc").alias("acc"),
        "t006_dat_preopn",
        "t006_dat_can",
    )
    accounts = holders.join(master, keys).join(dates, keys, "left")
    opened = F.coalesce("t006_dat_preopn", "dat_reg")
    return _universe(
        accounts,
        {
            "id_cliente": F.col("num_cus"),
            "id_sucursal_apertura": F.col("brn_open"),
            "id_cuenta": F.col("id_cuenta"),
            "fec_apertura": opened,
            "fec_cancelacion": F.coalesce("t006_dat_can", "dat_annulment"),
            "id_sucursal_gestora": F.col("t041_cen_acct"),
            "cod_producto": F.concat_ws("-", "t041_cod_product", "t041_cod_sprod"),
            "fec_ultima_txn": F.col("t041_dat_lastope"),
            "num_ultima_txn": F.col("t041_num_operation"),
            "id_sucursal_ultima_txn": F.col("t041_cen_lastmod"),
            "cod_usuario_ultima_txn": F.col("t041_lastmoduser"),
            "cod_bloqueo": F.when(F.col("t041_flg_blockcod") == "S", "BLOQUEADA").otherwise("SIN BLOQUEO"),
            "desc_cod_titular": holder_role(F.col("key_partic"), F.col("partseq")),
            "cod_tipo_persona": person_type(F.col("t041_cod_rsnsubj")),
            "cod_estatus": decode(F.col("t041_flg_status"), fixed.LEGACY_STATUS, F.col("t041_flg_status")),
            "cod_tipo_moneda": F.col("t041_fcc"),
            "sld_actual": F.col("t041_wdrwbal"),
            "num_dias_inactividad": _days_since(F.col("t041_dat_lastope"), params),
            "plazodeposito": F.lit(""),
            "ind_cuenta_nueva": _is_new(opened, params),
            "num_dias_antiguedad": _days_since(opened, params),
            "fec_carga": params.now,
            "cod_sistema": F.lit(fixed.LEGACY),
        },
    )


def core_accounts(tables: Tables, snapshot: DataFrame, params: Params) -> DataFrame:
    """New-core accounts with their earliest detail row and number of movements.

    All three inputs are keyed by the protected account number, so each is shuffled once.
    """
    raw = tables["rd_fin_cuentav2"]
    payload = ["sucursalapertura", "sucursal", "usuario", "tipobloqueo"]
    detail = best_by(
        raw.where(_on_day(raw, "fifecha", params, up_to=True)).select(
            F.col("numerocuenta").alias("cta_encrypt"), *payload, "fechacambio"
        ),
        ["cta_encrypt"],
        [oldest("fechacambio"), *[oldest(name) for name in payload]],
    ).drop("fechacambio")
    movements = (
        tables["rd_fin_990pf"].groupBy(F.col("cuenta").alias("cta_encrypt")).agg(F.count("*").alias("movements"))
    )
    accounts = (
        snapshot.withColumn("opened", epoch_ms(F.col("fechaapertura")))
        .withColumn("cancelled", epoch_ms(F.col("fechacancelacion")))
        .withColumn("last_move", epoch_ms(F.col("fechaultimomovimiento")))
        .join(detail, "cta_encrypt", "left")
        .join(movements, "cta_encrypt", "left")
    )
    blocked = F.col("tipobloqueo").isNotNull() & (F.trim("tipobloqueo") != "")
    return _universe(
        accounts,
        {
            "id_cliente": F.col("id_cliente"),
            "id_sucursal_apertura": F.col("sucursalapertura"),
            "id_cuenta": F.col("id_cuenta"),
            "fec_apertura": F.col("opened").cast("date"),
            "fec_cancelacion": F.col("cancelled"),
            "id_sucursal_gestora": F.col("centrocontable"),
            "cod_producto": F.trim(rebuilt_product(F.col("producto"))),
            "fec_ultima_txn": F.col("last_move"),
            "num_ultima_txn": F.col("movements"),
            "id_sucursal_ultima_txn": F.col("sucursal"),
            "cod_usuario_ultima_txn": F.col("usuario"),
            "cod_bloqueo": F.when(blocked, "BLOQUEADA").otherwise("SIN BLOQUEO"),
            "desc_cod_titular": F.lit(fixed.HOLDER),
            "cod_tipo_persona": person_type(F.col("personalidad")),
            "cod_estatus": decode(F.trim("estatuscuenta"), fixed.CORE_STATUS, F.col("estatuscuenta")),
            "cod_tipo_moneda": F.col("moneda"),
            "sld_actual": F.col("saldototal").try_cast(MONEY),
            "num_dias_inactividad": _days_since(F.col("last_move"), params),
            "plazodeposito": F.col("plazodeposito"),
            "ind_cuenta_nueva": _is_new(F.col("opened"), params),
            "num_dias_antiguedad": _days_since(F.col("opened"), params),
            "fec_carga": params.now,
            "cod_sistema": F.lit(fixed.CORE),
        },
    )


def product_families(tables: Tables, universe: DataFrame, params: Params) -> DataFrame:
    """Product levels and family of every holder row; two term products carry their term."""
    catalogue = tables["cu_ebx_catm_gs_productos_captacion_niveles"].withColumn(
        "_key", F.trim("fcproducto_subproducto")
    )
    holders = universe.where(F.col("desc_cod_titular") == fixed.HOLDER).select(
        "id_cuenta",
        F.trim("cod_producto").alias("_key"),
        F.col("cod_producto").alias("_product"),
        "plazodeposito",
        "cod_sistema",
    )
    level = "fcnuevo_producto_nivel_0{}".format
    last = F.col(level(7))
    with_term = F.concat_ws(" ", last, F.col("plazodeposito"), F.lit("Dias"))
    return holders.join(catalogue, "_key", "left").select(
        "id_cuenta",
        F.trim("fcproducto_subproducto").alias("cod_producto"),
        product_family(F.col(level(3)), F.col(level(4))).alias("cod_familia_producto"),
        F.trim("fcnivel").alias("cod_nivel_cuenta"),
        *[F.trim(level(n)).alias(f"cod_producto_nivel_0{n}") for n in range(1, 7)],
        F.when(F.col("_product").isin(fixed.TERM_PRODUCTS), with_term).otherwise(last).alias("cod_producto_nivel_07"),
        "cod_sistema",
        params.now.alias("fec_carga"),
    )
