"""Data contracts: table matching, field assembly by precedence, nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.naming import ascii_slug, business_name, inferred_type, leaf_name
from ledgerloom.session import cut, setting

TABLE_FIELD = ["table_name", "field_name"]


def _filled(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def matched_tables(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The table each request means.

    ``requests`` has request_id, request_rank and requested (a name, tried in rank order);
    ``catalogue`` database_rank, schema_name and table_name. Per database and name, the exact
    name wins over its last part, that over the name without separators; the first database
    and then the first name that hit decide. Names meet through equi-joins on their keys.
    """

    def compact(col: Column) -> Column:
        return F.replace(ascii_slug(col), F.lit("-"), F.lit(""))

    table, schema = F.col("table_name"), F.col("schema_name")
    keys = F.array(
        F.struct(F.lit("name").alias("kind"), F.lower(table).alias("key")),
        F.struct(F.lit("name").alias("kind"), F.lower(F.concat_ws(".", schema, table)).alias("key")),
        F.struct(F.lit("compact").alias("kind"), compact(table).alias("key")),
    )
    index = (
        catalogue.select("database_rank", F.struct("schema_name", "table_name").alias("_table"), F.inline(keys))
        .groupBy("kind", "key", "database_rank")
        .agg(F.max("_table").alias("_table"))
    )
    raw = F.trim("requested")
    last = leaf_name(raw)
    tries = F.array(
        F.struct(F.lit(1).alias("tier"), F.lit("name").alias("kind"), F.lower(raw).alias("key")),
        F.struct(F.lit(2).alias("tier"), F.lit("name").alias("kind"), F.lower(last).alias("key")),
        F.struct(F.lit(3).alias("tier"), F.lit("compact").alias("kind"), compact(last).alias("key")),
    )
    asked = requests.where(F.coalesce(raw, F.lit("")) != "").select("request_id", "request_rank", F.inline(tries))
    best = (
        asked.join(index, ["kind", "key"])
        .groupBy("request_id")
        .agg(F.min(F.struct("database_rank", "request_rank", "tier", "_table")).alias("_best"))
    )
    ids = requests.select("request_id").distinct()
    return ids.join(best, "request_id", "left").select(
        "request_id",
        F.col("_best.database_rank").alias("database_rank"),
        F.col("_best.tier").alias("tier"),
        F.col("_best._table.schema_name").alias("schema_name"),
        F.col("_best._table.table_name").alias("table_name"),
    )


def contract_fields(
    fields: DataFrame, profile: DataFrame, ddl: DataFrame, sample: DataFrame, dictionary: DataFrame
) -> DataFrame:
    """Fields of every table with each attribute taken from the first source that has it.

    ``fields`` has table_name, position, field_name, field_type, description and functions.
    The four side tables are keyed by table and lower-case field name, so one partitioning
    of the fields serves all four joins. What is worked out of a field alone is so before they move.
    """
    keys = ["table_name", "_field"]

    def side(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
        return df.select(
            "table_name",
            F.lower("field_name").alias("_field"),
            F.lit(True).alias(f"{prefix}_found"),
            *[F.col(name).alias(f"{prefix}_{name}") for name in columns],
        )

    rows = (
        fields.withColumn("_field", F.lower("field_name"))
        .withColumn("_inferred", inferred_type(F.col("field_name"), F.col("functions")))
        .drop("functions")
        .join(side(profile, "p", ["logical_type", "physical_type", "required", "example"]), keys, "left")
        .join(side(ddl, "d", ["logical_type", "physical_type", "required", "partitioned"]), keys, "left")
        .join(side(sample, "s", ["example"]), keys, "left")
        .join(side(dictionary, "w", ["business_name", "description"]), keys, "left")
    )
    col = F.col
    example = F.when(col("p_found"), col("p_example")).otherwise(col("s_example"))
    return rows.select(
        "table_name",
        "position",
        "field_name",
        F.coalesce(_filled(col("p_logical_type")), _filled(col("d_logical_type")), "_inferred").alias("logical_type"),
        F.coalesce(_filled(col("d_physical_type")), _filled(col("p_physical_type"))).alias("physical_type"),
        F.coalesce(_filled(col("w_description")), col("description")).alias("description"),
        F.coalesce(
            F.when(col("p_found"), F.coalesce("p_required", F.lit(False))), col("d_required"), F.lit(False)
        ).alias("required"),
        F.coalesce(_filled(col("w_business_name")), business_name(col("field_name"))).alias("business_name"),
        col("field_type").alias("classification"),
        F.coalesce("d_partitioned", F.lit(False)).alias("partitioned"),
        _filled(example).alias("example"),
    )


def of_products(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Rows of the tables that are products. They lie by table then, and what is joined to them need move only there."""
    return rows.join(products.select("table_name"), "table_name", "left_semi")


def contract_documents(fields: DataFrame, products: DataFrame) -> DataFrame:
    """Contracts in long form as JSON, empty parts left out: one "contract" row per table, one "property" row per field.

    ``products`` has table_name, product, domain, purpose, frequency, granularity and created. ``position`` orders the
    properties of a table; contract rows have 0 and the number of fields. Tables without fields have no contract.
    """
    col = F.col
    # Fields that lie by their table stay there, for their own joins and for this one. Counted and listed: what joins
    # have put together is written once, not joined a second time for the count.
    with setting(fields.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        fields = cut(of_products(fields, products), "contract_fields")
    field = F.struct(
        col("field_name").alias("name"),
        col("logical_type").alias("logicalType"),
        col("physical_type").alias("physicalType"),
        "description",
        "required",
        col("business_name").alias("businessName"),
        "classification",
        F.when(col("partitioned"), True).alias("partitioned"),
        F.when(col("partitioned"), 1).alias("partitionKeyPosition"),
        F.when(col("example").isNotNull(), F.array("example")).alias("examples"),
    )
    counted = fields.groupBy("table_name").agg(F.count("*").alias("field_count"))
    table = col("table_name")
    schema = F.struct(
        leaf_name(table).alias("name"),
        table.alias("physicalName"),
        F.lit("object").alias("logicalType"),
        F.lit("table").alias("physicalType"),
        F.coalesce(_filled(col("purpose")), F.concat(F.lit("Modelo tabular publicado en "), table, F.lit("."))).alias(
            "description"
        ),
        F.coalesce(
            _filled(col("granularity")), F.concat(F.lit("Una fila por registro publicado en "), table, F.lit("."))
        ).alias("dataGranularityDescription"),
    )
    tags = F.filter(
        F.array("domain", "frequency"), lambda tag: F.coalesce(tag, F.lit("")) != ""
    )
    tags = F.transform(tags, lambda tag: F.replace(F.lower(F.trim(tag)), F.lit(" "), F.lit("_")))
    document = F.struct(
        F.lit("v3.1.0").alias("apiVersion"),
        F.lit("DataContract").alias("kind"),
        ascii_slug(table).alias("id"),
        ascii_slug(col("product")).alias("name"),
        F.lit("0.1.0").alias("version"),
        F.lit("active").alias("status"),
        _filled(col("domain")).alias("domain"),
        col("product").alias("dataProduct"),
        F.struct(
            F.coalesce(_filled(col("purpose")), F.concat(F.lit("Contrato del dataset "), table, F.lit("."))).alias(
                "purpose"
            ),
            F.concat(F.lit("Frecuencia: "), col("frequency"), F.lit(".")).alias("usage"),
        ).alias("description"),
        F.when(F.size(tags) > 0, tags).alias("tags"),
        F.array(schema).alias("schema"),
        col("created").alias("contractCreatedTs"),
    )
    heads = counted.join(products, "table_name").select(
        "table_name", F.lit("contract").alias("part"), F.lit(0).cast("bigint").alias("position"), "field_count",
        F.to_json(document).alias("body"),
    )
    rows = fields.select(
        "table_name", F.lit("property").alias("part"), col("position").cast("bigint").alias("position"),
        F.lit(None).cast("bigint").alias("field_count"), F.to_json(field).alias("body"),
    )
    return heads.unionByName(rows)
