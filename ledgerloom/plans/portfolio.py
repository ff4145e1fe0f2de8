"""Balances, the active portfolio and the account master built on the universe."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fixed_values as fixed
from ledgerloom.functions.columns import (
    MONEY,
    balance_band,
    iso_week_code,
    negative_id,
    padded_branch,
    spread_nulls,
)
from ledgerloom.operators.lookup import looked_up
from ledgerloom.params import Params

Tables = Mapping[str, DataFrame]


def period_balances(tables: Tables, params: Params) -> DataFrame:
    """Legacy balances of one day of one month, current table and history together.

    The day picks one of the wide tables' columns, so the scans read three columns.
    """

    def read(table: str, prefix: str) -> DataFrame:
        return (
            tables[table]
            .where(F.col(f"{prefix}_periodo") == params.month_period)
            .select(
                F.concat(f"{prefix}_cen_reg", f"{prefix}_acc").alias("id_cuenta"),
                F.col(f"{prefix}_wdrwbal_{params.balance_day}").cast(MONEY).alias("sld_disponible"),
            )
        )

    both = read("rd_bgdt503", "t503").unionByName(read("rd_bgdt504", "t504"))
    return both.select(
        "id_cuenta", "sld_disponible", F.lit(fixed.LEGACY).alias("cod_sistema"), params.now.alias("fec_carga")
    )


def available_balances(universe: DataFrame, period: DataFrame, snapshot: DataFrame, params: Params) -> DataFrame:
    """Available balance and its band per account: the largest amount either system reports.

    Only the amount of the winning row is used, so a plain aggregate replaces the ranking.
    A missing amount sorts above every other one and therefore wins.
    """
    core = snapshot.select("id_cuenta", F.col("saldodisponible").try_cast(MONEY).alias("sld_disponible"))
    amounts = period.select("id_cuenta", "sld_disponible").unionByName(core)
    largest = amounts.groupBy("id_cuenta").agg(
        F.when(F.count("*") == F.count("sld_disponible"), F.max(F.abs("sld_disponible"))).alias("sld_disponible")
    )
    best = largest.select(F.trim("id_cuenta").alias("_key"), "sld_disponible")
    return (
        universe.select("id_cuenta", "cod_sistema", F.trim("id_cuenta").alias("_key"))
        .join(best, "_key", "left")
        .select("id_cuenta", "sld_disponible", "cod_sistema")
        .distinct()
        .select(
            "id_cuenta",
            "sld_disponible",
            balance_band(F.col("sld_disponible")).alias("cod_sld_disponible"),
            "cod_sistema",
            params.now.alias("fec_carga"),
        )
    )


def with_links(universe: DataFrame, links: DataFrame) -> DataFrame:
    """The universe with the ids that the links of its rows' own system hold.

    Legacy rows find theirs by the legacy id, new-core rows by the new-core id.
    """
    legacy = links.where(F.col("id_cliente_alnova").isNotNull()).select(
        F.col("id_cliente_alnova").alias("id_cliente"),
        "cod_sistema",
        F.col("id_cliente_finacle").alias("_legacy_core"),
        F.col("id_cliente_unico").alias("_legacy_unique"),
        F.col("id_icu_digital").alias("_legacy_digital"),
    )
    core = links.where(F.col("id_cliente_finacle").isNotNull()).select(
        F.col("id_cliente_finacle").alias("id_cliente"),
        "cod_sistema",
        F.col("id_cliente_alnova").alias("_core_legacy"),
        F.col("id_cliente_unico").alias("_core_unique"),
        F.col("id_icu_digital").alias("_core_digital"),
    )
    by = ["id_cliente", "cod_sistema"]
    return universe.join(legacy, by, "left").join(core, by, "left")


ATTRIBUTES = ["cod_familia_producto", "cod_nivel_cuenta", *[f"cod_producto_nivel_0{n}" for n in range(1, 8)]]


def assembled_portfolio(
    universe: DataFrame, links: DataFrame, products: DataFrame, balances: DataFrame, params: Params
) -> DataFrame:
    """The universe with customer ids, product attributes and available balance."""
    return with_accounts(with_links(universe, links), products, balances, params)


def with_accounts(
    linked: DataFrame, products: DataFrame, balances: DataFrame, params: Params
) -> DataFrame:
    """Linked rows of the universe with the product attributes and available balance of their account.

    Both joins are keyed by the account alone, the product being compared behind the key, so that the wide rows move once,
    or not at all where the three are tables in buckets of the account.
    """
    sold = products.select(F.col("id_cuenta").alias("_account"), F.col("cod_producto").alias("_product"), *ATTRIBUTES)
    money = balances.select("id_cuenta", "sld_disponible", "cod_sld_disponible")
    same_product = F.col("cod_producto") == F.col("_product")
    match = [F.col("id_cuenta") == F.col("_account"), F.coalesce(same_product, F.lit(False))]
    joined = linked.join(money, "id_cuenta", "left").join(sold, match, "left").drop("_account")
    return joined.select(
        F.when(F.col("cod_sistema") == fixed.LEGACY, F.col("id_cliente"))
        .otherwise(F.col("_core_legacy"))
        .alias("id_cliente_alnova"),
        F.when(F.col("cod_sistema") == fixed.CORE, F.col("id_cliente"))
        .otherwise(F.col("_legacy_core"))
        .alias("id_cliente_finacle"),
        F.coalesce("_legacy_unique", "_core_unique").alias("id_cliente_unico"),
        F.coalesce("_legacy_digital", "_core_digital").alias("id_icu_digital"),
        "cod_tipo_persona",
        "id_cuenta",
        "id_sucursal_apertura",
        "id_sucursal_gestora",
        "desc_cod_titular",
        "cod_estatus",
        "fec_apertura",
        "fec_cancelacion",
        "cod_bloqueo",
        "cod_tipo_moneda",
        "fec_ultima_txn",
        "id_sucursal_ultima_txn",
        "cod_usuario_ultima_txn",
        "num_ultima_txn",
        "num_dias_inactividad",
        "ind_cuenta_nueva",
        "num_dias_antiguedad",
        F.col("_product").alias("cod_producto"),
        *ATTRIBUTES,
        "sld_actual",
        F.coalesce("sld_disponible", F.lit(0).cast(MONEY)).alias("sld_disponible"),
        "cod_sld_disponible",
        params.now.alias("fec_carga"),
        "cod_sistema",
    )


def active_portfolio(assembled: DataFrame, params: Params) -> DataFrame:
    """Distinct rows that are not cancelled (a missing status drops out too), with the holder flag last."""
    kept = assembled.where(F.col("cod_estatus") != fixed.CANCELLED).drop("fec_cancelacion", "fec_carga")
    columns = [c for c in kept.columns if c != "cod_sistema"]
    return (
        kept.distinct()
        .withColumn("fec_carga", params.now)
        .select(
            *columns,
            "fec_carga",
            "cod_sistema",
            F.when(F.col("desc_cod_titular") == fixed.HOLDER, "T").otherwise("O").alias("cod_titular"),
        )
    )


def account_master(tables: Tables, portfolio: DataFrame, links: DataFrame, params: Params) -> DataFrame:
    """The portfolio under master ids, six-position branches (one row per branch), advisor and opening week."""
    advisors = (
        tables["cu_portafolio_fenix_analitica_crm_historica"]
        .where(F.col("semanaproceso") == params.advisor_period)
        .select(
            F.col("cuenta_alnova").alias("id_cuenta"),
            "id_empleado",
            "tipo_relacion",
            padded_branch(F.col("id_sucursal_asignada")).alias("id_sucursal_portafolio"),
        )
    )

    def master(system: str, column: str) -> DataFrame:
        return links.where(F.col("cod_sistema") == system).select(
            F.col(column).alias(f"_key_{column}"),
            F.col("id_master").alias(f"_master_{column}"),
            F.col(column).alias(f"_own_{column}"),
        )

    renumbered = ["id_sucursal_apertura", "id_sucursal_gestora", "id_sucursal_ultima_txn", "id_sucursal_portafolio"]
    systems = {"id_cliente_alnova": fixed.LEGACY, "id_cliente_finacle": fixed.CORE}
    by = ["id_cuenta", *systems]
    # Advisor and master ids are found for the ids alone; the wide rows move once, to meet what was found.
    found = portfolio.select(F.xxhash64(*by).alias("_row"), *by).join(advisors, "id_cuenta", "left")
    for column, system in systems.items():
        found = found.withColumn(f"_key_{column}", spread_nulls(F.col(column), F.col("id_cuenta"))).join(
            master(system, column), f"_key_{column}", "left"
        )
    found = found.select(
        "_row",
        *[F.col(name).alias(f"_of_{name}") for name in by],
        "id_empleado",
        "tipo_relacion",
        "id_sucursal_portafolio",
        F.coalesce(
            *[F.col(f"_master_{column}") for column in systems],
            *[negative_id(F.col(f"_own_{column}"), "bigint") for column in systems],
        ).alias("id_master"),
    )
    # The same row twice would meet its rows twice.
    found = found.repartition("_row").distinct()
    # The hash is the key; the ids are compared behind it, NULL being equal to NULL.
    same = [F.coalesce(F.col(n) == F.col(f"_of_{n}"), F.col(n).isNull() & F.col(f"_of_{n}").isNull()) for n in by]
    rows = portfolio.withColumn("_row", F.xxhash64(*by)).join(found.withColumnRenamed("_row", "_of_row"), [
        F.col("_row") == F.col("_of_row"), *same
    ], "left")
    rows = looked_up(rows, renumbered, tables["rd_tcdt078"], "t078_centro_4", "t078_centro_6")
    six = {column: F.coalesce(F.col(f"_found_{column}"), F.col(column)).alias(column) for column in renumbered}
    master_rows = rows.select(
        "_row",
        "id_master",
        "id_cliente_alnova",
        "id_cliente_finacle",
        "id_cliente_unico",
        "id_icu_digital",
        "cod_tipo_persona",
        "cod_tipo_moneda",
        "id_cuenta",
        six["id_sucursal_apertura"],
        six["id_sucursal_gestora"],
        "desc_cod_titular",
        "cod_estatus",
        "fec_apertura",
        iso_week_code(F.col("fec_apertura").cast("date")).alias("num_sem_apertura"),
        "cod_bloqueo",
        "fec_ultima_txn",
        six["id_sucursal_ultima_txn"],
        "cod_usuario_ultima_txn",
        "num_ultima_txn",
        F.nullif(F.trim("id_empleado").try_cast("int"), F.lit(0)).alias("id_empleado_portafolio"),
        F.trim("tipo_relacion").alias("cod_relacion_portafolio"),
        six["id_sucursal_portafolio"],
        "cod_producto",
        "cod_nivel_cuenta",
        *[f"cod_producto_nivel_0{n}" for n in range(1, 8)],
        "sld_actual",
        "sld_disponible",
        "cod_sld_disponible",
        "fec_carga",
        "cod_sistema",
        F.lit(int(params.week_period)).alias("num_periodo_sem"),
        F.when(F.col("desc_cod_titular") == fixed.HOLDER, "T").otherwise("O").alias("cod_titular"),
    )
    # Rows lie by the hash of some of their columns already, so equal ones are together.
    return master_rows.distinct().drop("_row")
