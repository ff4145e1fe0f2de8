"""Customer identity: legacy, new-core, unique and digital ids of one person."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fixed_values as fixed
from ledgerloom.functions.columns import dash_id, negative_id, newest, oldest, spread_nulls
from ledgerloom.operators.rows import argmin_concat, best_by
from ledgerloom.params import Params
from ledgerloom.session import cut

Tables = Mapping[str, DataFrame]


def _digital_ids(tables: Tables) -> DataFrame:
    """Latest digital id per legacy customer."""
    latest = best_by(
        tables["rd_mcdt403"].select("t403_num_clte", "t403_bdmid", "t403_stp_ultmod"),
        ["t403_num_clte"],
        [newest("t403_stp_ultmod"), oldest("t403_bdmid")],
    )
    return latest.select("t403_num_clte", F.col("t403_bdmid").alias("id_icu_digital"))


def core_links(tables: Tables, params: Params) -> DataFrame:
    """One row per new-core customer with its best-matching legacy, unique and digital ids.

    The candidates of a conversion id compete before the customers join: every criterion but
    the customer's own date belongs to the candidate, and that date is the same for all
    candidates of one customer row. So the join meets one candidate per conversion id, and
    an id with very many candidates is reduced inside the map tasks.
    """
    person = tables["rd_cencuentaperson_clienteunico"].select(
        F.col("fiid_cliente_unico").alias("id_conversion"),
        "fccliente_alnova",
        F.col("fdfecha_alta").alias("_person_since"),
    )
    unique = tables["rd_pedt065"].select(
        F.col("t065_acc_country").alias("fipais"),
        F.col("t065_acc_channel").alias("ficanal"),
        F.col("t065_acc_brn").alias("fisucursal"),
        F.col("t065_acc_folio").alias("fifolio"),
        "t065_num_cus",
        "t065_stp_last_mod",
    )
    matched = (
        tables["rd_cenconversion_clienteunico"]
        .select(
            F.col("fiid_cliente_unico").try_cast("int").alias("id_conversion"),
            "fipais",
            "ficanal",
            "fisucursal",
            "fifolio",
        )
        .where(F.col("id_conversion").isNotNull())
        .join(unique, ["fipais", "ficanal", "fisucursal", "fifolio"], "left")
        .join(person, "id_conversion", "left")
        .withColumn("id_cliente_alnova", F.coalesce("t065_num_cus", "fccliente_alnova"))
        .withColumn("_digital", spread_nulls(F.col("id_cliente_alnova"), F.col("id_conversion"), F.col("fifolio")))
    )
    digital = _digital_ids(tables).withColumnRenamed("t403_num_clte", "_digital")
    scored = matched.join(digital, "_digital", "left").select(
        "id_conversion",
        "id_cliente_alnova",
        dash_id(F.col("fipais"), F.col("ficanal"), F.col("fisucursal"), F.col("fifolio")).alias("id_cliente_unico"),
        "id_icu_digital",
        F.col("t065_stp_last_mod").alias("fec_ult_mod_cte_unico"),
        (F.col("fifolio").isNotNull().cast("int") + F.col("t065_num_cus").isNotNull().cast("int")).alias("_complete"),
        F.col("id_icu_digital").isNotNull().cast("int").alias("_has_digital"),
        F.coalesce((F.col("fccliente_alnova") == F.col("t065_num_cus")).cast("int"), F.lit(0)).alias("_agrees"),
        "_person_since",
    )
    match = [newest("_complete"), newest("_has_digital"), newest("_agrees")]
    dates = [newest("_person_since"), newest("fec_ult_mod_cte_unico")]
    ids = [oldest(name) for name in ["id_cliente_unico", "id_cliente_alnova", "id_icu_digital"]]
    candidates = best_by(scored, ["id_conversion"], [*match, *dates, *ids])
    customers = tables["rd_tacuctefinacle"].select(
        F.col("fiid_cliente_unico").alias("id_conversion"),
        F.col("fccliente_cif").alias("id_cliente_finacle"),
        F.col("fdfecha_alta").alias("_customer_since"),
    )
    rows = customers.join(candidates, "id_conversion", "left").na.fill(0, ["_complete", "_has_digital", "_agrees"])
    order = [*match, newest("_customer_since"), *dates, *ids, oldest("id_conversion")]
    return best_by(rows, ["id_cliente_finacle"], order).select(
        "id_cliente_alnova",
        "id_cliente_finacle",
        "id_cliente_unico",
        "id_icu_digital",
        "id_conversion",
        "fec_ult_mod_cte_unico",
        params.now.alias("fec_carga"),
        F.lit(fixed.CORE).alias("cod_sistema"),
    )


def legacy_links(tables: Tables, core: DataFrame, params: Params) -> DataFrame:
    """One row per legacy customer with its latest unique and digital ids and its new-core id."""
    customers = (
        tables["rd_pedt008"]
        .select(F.col("num_cus").alias("id_cliente_alnova"))
        .distinct()
        .withColumn("_key", F.trim("id_cliente_alnova"))
    )
    parts = ["t065_acc_country", "t065_acc_channel", "t065_acc_brn", "t065_acc_folio"]
    unique = best_by(
        tables["rd_pedt065"].select("t065_num_cus", *parts, "t065_stp_last_mod"),
        ["t065_num_cus"],
        [newest("t065_stp_last_mod"), oldest("t065_acc_folio"), *[oldest(part) for part in parts[:3]]],
    ).select(
        F.trim("t065_num_cus").alias("_key"),
        dash_id(*[F.col(part) for part in parts], missing="0").alias("id_cliente_unico"),
        F.col("t065_stp_last_mod").alias("fec_ult_mod_cte_unico"),
    )
    digital = _digital_ids(tables).select(F.trim("t403_num_clte").alias("_key"), "id_icu_digital")
    core_ids = argmin_concat(core, "id_cliente_alnova", "id_cliente_finacle", "id_conversion").select(
        F.trim("id_cliente_alnova").alias("_key"), "id_cliente_finacle", "id_conversion"
    )
    return (
        customers.join(unique, "_key", "left")
        .join(digital, "_key", "left")
        .join(core_ids, "_key", "left")
        .select(
            "id_cliente_alnova",
            "id_cliente_finacle",
            "id_cliente_unico",
            "id_icu_digital",
            "id_conversion",
            "fec_ult_mod_cte_unico",
            params.now.alias("fec_carga"),
            F.lit(fixed.LEGACY).alias("cod_sistema"),
        )
    )


def customer_links(tables: Tables, core: DataFrame, legacy: DataFrame, params: Params) -> DataFrame:
    """Both link tables under one master id: the first of four lookups that answers, else a negative own id."""
    links = core.select(*legacy.columns).unionByName(legacy).drop("fec_carga")
    columns = ["id_cliente_alnova", "id_cliente_finacle", "id_cliente_unico", "id_icu_digital"]
    salt = [F.coalesce("id_cliente_alnova", "id_cliente_finacle")]
    # One pass over the master table serves all four lookups.
    masters = (
        tables["cd_cte_master_diaria"]
        .where(F.col("cod_tipo_cliente").isin(list(fixed.MASTER_KINDS)))
        .groupBy("cod_tipo_cliente", "id_cliente")
        .agg(F.min("id_master").alias("_master"))
    )
    masters = cut(masters, "masters")
    for kind, column in zip(fixed.MASTER_KINDS, columns):
        lookup = masters.where(F.col("cod_tipo_cliente") == kind).select(
            F.col("id_cliente").alias(f"_key_{column}"), F.col("_master").alias(f"_master_{column}")
        )
        links = links.withColumn(f"_key_{column}", spread_nulls(F.col(column), *salt)).join(
            lookup, f"_key_{column}", "left"
        )
    own = F.when(F.col("cod_sistema") == fixed.LEGACY, F.col("id_cliente_alnova")).otherwise(
        F.col("id_cliente_finacle")
    )
    return links.select(
        F.coalesce(*[F.col(f"_master_{column}").cast("bigint") for column in columns], negative_id(own)).alias(
            "id_master"
        ),
        *columns,
        "id_conversion",
        "fec_ult_mod_cte_unico",
        params.now.alias("fec_carga"),
        "cod_sistema",
    )
