"""Year-over-year figures and dashboard tables over the portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import pct_change
from ledgerloom.params import Params

AMOUNT = "decimal(38,2)"


def _old(params: Params) -> Column:
    """Opened a year or more before ``as_of``."""
    limit = F.lit(params.as_of) - F.expr("INTERVAL 1 YEAR")
    return F.col("fec_apertura") <= limit.cast("timestamp_ntz")


def _card(label: str, figures: DataFrame, digits: int = 2) -> DataFrame:
    """One row from the two figures ``now`` and ``before``; the change uses them unrounded."""
    return figures.select(
        F.lit(label).alias("eje"),
        F.round("now", digits).cast(AMOUNT).alias("total_actual"),
        F.round("before", digits).cast(AMOUNT).alias("total_anterior"),
        pct_change(F.col("now"), F.col("before")).alias("variacion_pct"),
    )


def total_accounts(portfolio: DataFrame, params: Params) -> DataFrame:
    """Accounts now and a year ago, both counted in one scan."""
    count = "decimal(20,2)"
    figures = portfolio.agg(
        F.count("*").cast(count).alias("now"), F.count_if(_old(params)).cast(count).alias("before")
    )
    return _card("Total cuentas", figures)


def total_balance(portfolio: DataFrame, params: Params) -> DataFrame:
    zero = F.lit(0).cast("decimal(24,2)")
    amount = F.col("sld_actual")
    figures = portfolio.agg(
        F.coalesce(F.sum(amount).cast("decimal(24,2)"), zero).alias("now"),
        F.coalesce(F.sum(F.when(_old(params), amount)).cast("decimal(24,2)"), zero).alias("before"),
    )
    return _card("Saldo total", figures)


def average_balance(portfolio: DataFrame, params: Params) -> DataFrame:
    """Average balance; the change is taken between the unrounded averages."""
    amount = F.col("sld_actual")

    def mean(value: Column) -> Column:
        total, count = F.sum(value).cast("decimal(24,2)"), F.count(value).cast("decimal(14,0)")
        return F.coalesce(F.try_divide(total, count).cast("decimal(26,10)"), F.lit(0).cast("decimal(26,10)"))

    figures = portfolio.agg(mean(amount).alias("now"), mean(F.when(_old(params), amount)).alias("before"))
    return _card("Saldo promedio", figures)


def region_summary(customers: DataFrame, accounts: DataFrame, active: str = "Activa") -> DataFrame:
    """Customers, accounts, active accounts and balance per region and segment, largest balance first.

    Customers without accounts count too. Customers are counted on their own table and
    accounts over an inner join, whose skewed side Spark can split; the two small results
    meet at the end. Each needs one distinct count, so no row is expanded.
    """
    group = ["region", "segmento"]
    people = customers.groupBy(*group).agg(F.countDistinct("cliente_id").alias("clientes"))
    held = (
        accounts.select("cliente_id", "cuenta_id", "estatus", "saldo_actual")
        .join(customers.select("cliente_id", *group), "cliente_id")
        .groupBy(*[F.col(name).alias(f"_{name}") for name in group])
        .agg(
            F.countDistinct("cuenta_id").alias("cuentas"),
            F.count_if(F.col("estatus") == active).alias("cuentas_activas"),
            F.round(F.sum("saldo_actual"), 2).cast(AMOUNT).alias("saldo_total"),
        )
    )
    same = F.col("region").eqNullSafe(F.col("_region")) & F.col("segmento").eqNullSafe(F.col("_segmento"))
    return (
        people.join(held, same, "left")
        .select(
            *group,
            "clientes",
            F.coalesce("cuentas", F.lit(0)).alias("cuentas"),
            F.coalesce("cuentas_activas", F.lit(0)).alias("cuentas_activas"),
            "saldo_total",
        )
        .orderBy(F.desc_nulls_first("saldo_total"), *group)
    )


def top_accounts(customers: DataFrame, accounts: DataFrame, limit: int = 10) -> DataFrame:
    """The accounts with the largest balances; each task keeps only its own top rows."""
    return (
        accounts.join(customers.select("cliente_id", "region", "segmento"), "cliente_id")
        .select("cuenta_id", "region", "segmento", "producto", "estatus", "saldo_actual")
        .orderBy(F.desc_nulls_first("saldo_actual"), F.col("cuenta_id"))
        .limit(limit)
    )
