"""Publication bundle of every run: assets, lineage events, product summary, plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.naming import (
    file_category,
    leaf_name,
    merged_description,
    port_type,
    product_status,
    split_last_dot,
    unicode_slug,
)
from ledgerloom.operators.rows import first_wins

PRODUCER = "ledgerloom"
SPEC = "https://openlineage.io/spec/facets/1-0-0/"


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


#: Columns of every asset; what a kind of asset does not have is NULL, and its tags are an empty array.
ASSET = {
    "asset_type": "string",
    "qualified_name": "string",
    "display_name": "string",
    "description": "string",
    "tags": "array<string>",
    "role": "string",
    "source_kind": "string",
    "file_category": "string",
    "size_bytes": "bigint",
    "storage_path": "string",
}


def _asset(rows: DataFrame, rank: int, values: Mapping[str, Column]) -> DataFrame:
    empty = {"tags": F.array()}
    columns = [
        values.get(name, empty.get(name, F.lit(None))).cast(kind).alias(name) for name, kind in ASSET.items()
    ]
    return rows.select("run_id", F.lit(rank).alias("rank"), F.col("pos").cast("bigint"), *columns)


def assets(runs: DataFrame, sources: DataFrame, files: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """Target, sources and files of every run, the first of each (type, name) kept with all it says.

    ``contracts`` has run_id (unique), schema_name, schema_description and tags of a run's contract; they name and describe
    the target, which else goes by its table name. ``sources`` may have contains_description and layer, ``files``
    file_category and storage_path; a file's category else follows from its path.
    """
    stated = runs.where(_filled("target_table")).select("run_id", "target_table", F.lit(0).alias("pos"))
    nothing = {"schema_name": "string", "schema_description": "string", "tags": "array<string>"}
    if contracts is None:
        stated = stated.withColumns({name: F.lit(None).cast(kind) for name, kind in nothing.items()})
    else:
        stated = stated.join(contracts.select("run_id", *nothing), "run_id", "left")
    target = _asset(
        stated,
        0,
        {
            "asset_type": F.lit("dataset"),
            "qualified_name": F.col("target_table"),
            "display_name": F.coalesce(F.nullif("schema_name", F.lit("")), "target_table"),
            "description": F.col("schema_description"),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "role": F.lit("target"),
        },
    )

    def given(rows: DataFrame, name: str, other: Column) -> Column:
        return F.col(name) if name in rows.columns else other

    layer = given(sources, "layer", F.lit(None).cast("string"))
    listed = _asset(
        sources.where(_filled("source_table")),
        1,
        {
            "asset_type": F.lit("dataset"),
            "qualified_name": F.col("source_table"),
            "display_name": leaf_name(F.col("source_table")),
            "description": given(sources, "contains_description", F.lit(None)),
            "tags": F.when(F.coalesce(layer, F.lit("")) != "", F.array(layer)).otherwise(F.array().cast("array<string>")),
            "role": F.lit("source"),
            "source_kind": F.col("source_kind"),
        },
    )
    evidence = _asset(
        files.where(_filled("relative_path")),
        2,
        {
            "asset_type": F.lit("file"),
            "qualified_name": F.col("relative_path"),
            "display_name": F.element_at(F.split("relative_path", "/"), -1),
            "role": F.lit("evidence"),
            "file_category": given(files, "file_category", file_category(F.col("relative_path"))),
            "size_bytes": F.col("size_bytes"),
            "storage_path": given(files, "storage_path", F.lit(None)),
        },
    )
    united = target.unionByName(listed).unionByName(evidence)
    return first_wins(united, ["run_id", "asset_type", "qualified_name"], ["rank", "pos"]).drop("rank", "pos")


def asset_columns(asset_rows: DataFrame, fields: DataFrame) -> DataFrame:
    """The columns of target assets in long form: run_id, qualified_name, position and what a contract field says.

    ``fields`` has run_id, position and further columns; a run has one target.
    """
    targets = asset_rows.where(F.col("role") == "target").select("run_id", "qualified_name")
    return fields.join(targets, "run_id").select("run_id", "qualified_name", *[c for c in fields.columns if c != "run_id"])


def _dataset(name: Column) -> Column:
    space, leaf = split_last_dot(name)
    return F.struct(space.alias("namespace"), leaf.alias("name"))


def lineage_events(
    modules: DataFrame, module_sources: DataFrame, relations: DataFrame, at: str, namespace: str
) -> DataFrame:
    """Lineage events in long form: a row per module, and a row per input and per target of its edges.

    ``part`` tells which: "event" rows hold the event without its lists, "input" rows a dataset, "target" rows the name of
    a table. ``position`` orders inputs and targets; event rows have 0.
    """
    dataset = "struct<namespace:string,name:string>"
    inputs = module_sources.where(_filled("source_table")).select(
        "run_id", "module_key", F.lit("input").alias("part"), F.col("pos").cast("bigint").alias("position"),
        _dataset(F.col("source_table")).cast(dataset).alias("dataset"),
    )
    named = relations.where(_filled("target_node") & _filled("module_key"))
    targets = named.groupBy("run_id", "module_key", "target_node").agg(F.min("id").alias("position")).select(
        "run_id", "module_key", F.lit("target").alias("part"), F.col("position").cast("bigint"),
        F.col("target_node").alias("target"),
    )
    event = F.struct(
        F.lit("COMPLETE").alias("eventType"),
        F.lit(at).alias("eventTime"),
        F.lit(PRODUCER).alias("producer"),
        F.struct(F.lit(namespace).alias("namespace"), F.col("module_key").alias("name")).alias("job"),
        F.struct(F.concat_ws("::", "run_id", "module_key").alias("runId")).alias("run"),
        F.when(_filled("target_table"), F.array(_dataset(F.col("target_table"))))
        .otherwise(F.array().cast("array<struct<namespace:string,name:string>>"))
        .alias("outputs"),
        F.struct(
            F.struct(
                F.lit(PRODUCER).alias("_producer"),
                F.lit(SPEC + "DocumentationJobFacet.json").alias("_schemaURL"),
                F.coalesce(F.nullif("module_name", F.lit("")), F.col("module_key")).alias("description"),
            ).alias("documentation"),
            F.struct(
                F.lit(PRODUCER).alias("_producer"),
                F.lit(SPEC + "SQLJobFacet.json").alias("_schemaURL"),
                F.coalesce("resolved_sql", F.lit("")).alias("query"),
            ).alias("sql"),
            F.struct("module_name", "sql_file_name").alias("module"),
        ).alias("facets"),
    )
    heads = modules.select(
        "run_id", "module_key", F.lit("event").alias("part"), F.lit(0).cast("bigint").alias("position"), event.alias("event")
    )
    return heads.unionByName(inputs, allowMissingColumns=True).unionByName(targets, allowMissingColumns=True)


def event_json(events: DataFrame) -> DataFrame:
    """Rows with the event, dataset or target of each as text."""
    options = {"ignoreNullFields": "false"}
    body = F.when(F.col("part") == "event", F.to_json("event", options)).when(
        F.col("part") == "input", F.to_json("dataset", options)
    )
    return events.select("run_id", "module_key", "part", "position", body.otherwise(F.col("target")).alias("body"))


def product_keys(runs: DataFrame) -> DataFrame:
    """Ids a run's product, output port and contract are known by."""
    product = unicode_slug(F.coalesce(F.nullif("target_table", F.lit("")), "product_name"))
    return runs.select(
        "run_id",
        product.alias("product_id"),
        F.coalesce("product_name", product).alias("product_label"),
        F.concat(unicode_slug(F.coalesce(F.nullif("target_table", F.lit("")), product)), F.lit("-port")).alias("port_id"),
        F.coalesce(F.nullif("target_table", F.lit("")), product).alias("port_label"),
        unicode_slug(F.regexp_replace("contract_file", r"(?i)(\.odcs\.yaml|\.yaml|\.yml)$", "")).alias("contract_id"),
        F.col("contract_file").alias("contract_label"),
    )


def enriched_events(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Events (long form) with product, port and contract facets on the run and on every dataset."""
    rows = events.join(keys, "run_id")
    product, port, contract = F.col("product_id"), F.col("port_id"), F.col("contract_id")
    link = F.concat(F.lit("/dataproducts/"), product)
    facet = F.struct(
        F.lit(PRODUCER).alias("_producer"),
        product.alias("dataProductId"),
        F.col("product_label").alias("dataProductName"),
        link.alias("dataProductHref"),
        port.alias("outputPortId"),
        F.col("port_label").alias("outputPortName"),
        F.concat(link, F.lit("/outputports/"), port).alias("outputPortHref"),
        contract.alias("dataContractId"),
        F.col("contract_label").alias("dataContractName"),
        F.concat(F.lit("/datacontracts/"), contract).alias("dataContractHref"),
    )

    def with_facet(d: Column) -> Column:
        return F.struct(
            d["namespace"].alias("namespace"), d["name"].alias("name"), F.struct(facet.alias("catalog")).alias("facets")
        )

    run_facet = F.struct(
        F.lit(PRODUCER).alias("_producer"), product.alias("dataProductId"), port.alias("outputPortId")
    )
    event = F.struct(
        "event.eventType",
        "event.eventTime",
        "event.producer",
        "event.job",
        F.struct(F.col("event.run.runId").alias("runId"), F.struct(run_facet.alias("catalog")).alias("facets")).alias("run"),
        F.transform("event.outputs", with_facet).alias("outputs"),
        "event.facets",
    )
    return rows.select(
        "run_id", "module_key", "part", "position",
        F.when(F.col("part") == "event", event).alias("event"),
        F.when(F.col("part") == "input", with_facet(F.col("dataset"))).alias("dataset"),
        "target",
    )


def product_summary(runs: DataFrame, contracts: DataFrame, sources: DataFrame, transformations: DataFrame) -> DataFrame:
    """Name, domain, status, description, tags, schema and counts of every run.

    ``contracts`` has one row per run with the contract's own values, where it has one. The sources themselves are rows
    of :func:`product_sources`.
    """
    counted = sources.groupBy("run_id").agg(
        F.count("*").alias("source_count"), F.count_distinct(F.nullif("source_table", F.lit(""))).alias("named_count")
    )
    fields = transformations.groupBy("run_id").agg(F.count("*").alias("_fields"))
    leaf = leaf_name(F.col("target_table"))
    tags = F.array_compact(F.array(F.nullif("domain", F.lit(""))))
    zero = F.lit(0)
    return (
        runs.join(contracts, "run_id", "left").join(counted, "run_id", "left").join(fields, "run_id", "left")
        .select(
            "run_id",
            F.coalesce("contract_product", "product_name", "target_table").alias("name"),
            "target_table",
            leaf.alias("schema_name"),
            F.col("target_table").alias("schema_physical_name"),
            "domain",
            tags.alias("tags"),
            port_type(F.coalesce("target_table", F.lit("")), F.lit(None).cast("string"), tags).alias("port_type"),
            product_status(F.coalesce("contract_status", "status")).alias("status"),
            merged_description(F.col("purpose"), F.col("usage"), F.col("limitations")).alias("description"),
            F.coalesce("contract_fields", "_fields", zero).cast("bigint").alias("field_count"),
            F.coalesce("source_count", zero).cast("bigint").alias("source_count"),
            F.coalesce("named_count", zero).cast("bigint").alias("distinct_source_count"),
        )
    )


def product_sources(sources: DataFrame) -> DataFrame:
    """Distinct sources of every run, one row each; their order is the names' own."""
    return sources.where(_filled("source_table")).select("run_id", "source_table").distinct()


def import_plan(
    runs: DataFrame, asset_rows: DataFrame, relations: DataFrame, modules: DataFrame, findings: DataFrame
) -> DataFrame:
    """What publishing a run would do: two switches and the number of things of each kind.

    All countable rows are united as (run, kind) and counted once.
    """
    role = F.when(F.col("asset_type") == "file", "file").otherwise(F.col("role"))
    counted = (
        asset_rows.select("run_id", role.alias("kind"))
        .unionByName(relations.select("run_id", F.lit("relation").alias("kind")))
        .unionByName(modules.select("run_id", F.lit("event").alias("kind")))
        .unionByName(findings.select("run_id", F.lit("finding").alias("kind")))
        .groupBy("run_id")
        .agg(
            *[
                F.count_if(F.col("kind") == kind).alias(name)
                for kind, name in {
                    "target": "target_dataset_count",
                    "source": "source_dataset_count",
                    "relation": "lineage_relation_count",
                    "event": "lineage_event_count",
                    "file": "evidence_file_count",
                    "finding": "quality_finding_count",
                }.items()
            ]
        )
    )
    named = F.coalesce(F.nullif("product_name", F.lit("")), F.nullif("target_table", F.lit("")))
    switches = runs.select(
        "run_id",
        named.isNotNull().alias("create_or_update_data_product"),
        _filled("contract_yaml").alias("publish_datacontract"),
    )
    counts = [c for c in counted.columns if c != "run_id"]
    return switches.join(counted, "run_id", "left").na.fill(0, counts)
