"""Lineage between tables, columns, steps and fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import fixed_values as fixed
from ledgerloom.functions.naming import (
    before_leaf,
    schema_group,
    source_tables,
    split_last_dot,
    transformation_class,
)
from ledgerloom.operators.graph import levels, upstream
from ledgerloom.operators.rows import numbered
from ledgerloom.session import many_tasks

MODULE = ["run_id", "module_key"]


def flow_edges(modules: DataFrame, sources: DataFrame, joins: DataFrame, field_sources: DataFrame) -> DataFrame:
    """Table-to-table edges of every module.

    The first source feeds the target directly, or through a UNION ALL node when it names
    several tables and the script unites them. Other sources carry the type of their join.
    Tables that only the column lineage knows come as LINEAGE edges. Sources, joins and fields
    move once, together, by their module, and what they need of each other is found there: a
    task holds all rows of a module, which are as many as one script has.
    """
    about = modules.select(*MODULE, "target_table", F.lower("resolved_sql").contains("union all").alias("_unites"))
    target, label = F.col("target_table"), F.col("_label")

    def part(df: DataFrame, kind: str, alias: Column, pos: Column, text: Column, tables: Column) -> DataFrame:
        return df.select(
            *MODULE, F.lit(kind).alias("_kind"), alias.cast("string").alias("_alias"), pos.alias("pos"),
            text.cast("string").alias("_text"), tables.cast("array<string>").alias("_tables"),
        )

    none = F.lit(None)
    alias, pos = F.lower("source_alias"), F.col("pos")
    # A field gives each of its tables once.
    known_fields = F.array_distinct(F.transform("physical_source_fields", _table_of))
    parts = (
        part(sources, "source", alias, pos, F.col("source_table"), none)
        .unionByName(part(joins, "join", alias, pos, F.upper("join_type"), none))
        .unionByName(part(field_sources, "field", none, none, none, known_fields).where(F.size("_tables") > 0))
        .repartition(many_tasks(sources.sparkSession), *MODULE)
        .sortWithinPartitions(*MODULE, "_alias")
    )
    is_source, is_join = F.col("_kind") == "source", F.col("_kind") == "join"
    # The last join of an alias tells its type; a missing alias is that of no join.
    last = F.max_by(F.when(is_join, F.col("_text")), F.when(is_join, F.col("pos")))
    placed = (
        parts.withColumn("_join", last.over(Window.partitionBy(*MODULE, "_alias")))
        .withColumn("_start", F.min(F.when(is_source, F.col("pos"))).over(Window.partitionBy(*MODULE)))
        .where(~is_join)
        .join(about, MODULE)
        .withColumn("_tables", F.when(is_source, source_tables(F.col("_text"))).otherwise(F.col("_tables")))
        .withColumn("_first", is_source & (F.col("pos") == F.col("_start")))
        .withColumn("_through", F.col("_first") & F.col("_unites") & (F.size("_tables") > 1))
        .withColumn("_label", F.when(F.col("_alias").isNotNull(), F.col("_join")))
        .withColumn("_label", F.coalesce("_label", F.lit("JOIN")))
    )

    def edge(source: Column, to: Column, name: Column, kinds: tuple[str, str], pivot: Column) -> Column:
        return F.struct(
            source.alias("source_node"),
            to.alias("target_node"),
            name.alias("relation_label"),
            F.lit(kinds[0]).alias("source_kind"),
            F.lit(kinds[1]).alias("target_kind"),
            pivot.alias("is_pivot"),
        )

    tables, never = ("table", "table"), F.lit(False)
    node = F.concat(target, F.lit("::union_all"))
    united = F.concat(
        F.transform("_tables", lambda t: edge(t, node, F.lit("UNION ALL"), ("table", "process"), never)),
        F.array(edge(node, target, F.lit("FROM / BASE"), ("process", "table"), F.lit(True))),
    )
    named = F.when(F.size("_tables") > 0, F.col("_tables")).otherwise(F.array("_text"))
    direct = F.transform(
        named, lambda t, at: edge(t, target, F.when(at == 0, "FROM / BASE").otherwise("SOURCE"), tables, at == 0)
    )
    joined = F.transform("_tables", lambda t: edge(t, target, label, tables, never))
    lineage = F.transform(
        F.filter("_tables", lambda t: t != target), lambda t: edge(t, target, F.lit("LINEAGE"), tables, never)
    )
    edges = F.when(~is_source, lineage).when(F.col("_through"), united).when(F.col("_first"), direct).otherwise(joined)
    found = placed.select(*MODULE, F.when(is_source, 0).otherwise(1).alias("_rank"), F.inline(edges))
    # A node keeps its LINEAGE edge only when no source edge leaves it. Repeats are dropped, and
    # the edges of a node found, in one order of the rows, where those of the module are.
    # The hash comes first, as names that begin alike are slow to sort.
    node = ["_node", *MODULE, "source_node"]
    rest = [c for c in found.columns if c not in [*node, "_rank"]]
    found = (
        found.withColumn("_node", F.xxhash64(*MODULE, "source_node"))
        .withColumn("_nth", F.row_number().over(Window.partitionBy(*node, *rest).orderBy("_rank")))
        .where("_nth = 1")
        .withColumn("_known", F.min("_rank").over(Window.partitionBy(*node)))
        .where("_rank = 0 OR _known = 1")
        .drop("_rank", "_nth", "_known", "_node")
    )
    ends = {"source": F.col("source_node"), "target": F.col("target_node")}
    groups = [
        F.when(F.col(f"{end}_kind") == "process", "process").otherwise(schema_group(name)).alias(f"{end}_group")
        for end, name in ends.items()
    ]
    return found.select("*", *groups)


def _table_of(field: Column) -> Column:
    return F.when(field.contains("."), before_leaf(field)).otherwise(field)


def closure(latest: DataFrame, relations: DataFrame) -> DataFrame:
    """Every node upstream of each run's final table, with its least distance."""
    seeds = latest.select("run_id", F.col("final_table_name").alias("node"))
    edges = relations.join(latest.select("run_id"), "run_id", "left_semi")
    reached = upstream(seeds, edges, ["run_id"])
    return reached.join(latest.select("run_id", "final_table_name"), "run_id").select(
        "final_table_name", "run_id", "node", "depth"
    )


def physical_inputs(reached: DataFrame, schemas: Sequence[str] = tuple(fixed.INPUT_SCHEMAS)) -> DataFrame:
    """Physical tables among the reached nodes: allowed schemas, no process nodes."""
    node = F.col("node")
    physical = (
        node.like("%.%") & F.split_part(node, F.lit("."), F.lit(1)).isin(*schemas) & ~node.like("%::union\\_all")
    )
    return reached.where(physical).select("final_table_name", "run_id", node.alias("tabla_insumo")).distinct()


def column_sources(transformations: DataFrame) -> DataFrame:
    """One row per (field, physical column): base table and column, split at the last dot."""
    table, column = split_last_dot(F.col("_field"))
    return transformations.select(
        *MODULE, "field_name", F.explode("physical_source_fields").alias("_field")
    ).select(*MODULE, "field_name", table.alias("base_table"), column.alias("source_column"))


def expanded_sources(references: DataFrame, alias_columns: DataFrame, alias_tables: DataFrame) -> DataFrame:
    """Physical fields behind each field, through the sub-selects and CTEs its aliases stand for.

    ``references`` has run_id, field_name, physical_source_fields and columns (``alias.column``
    texts). A reference gives the alias column's own physical fields and the same column of
    every table of the alias.
    """
    own = references.select("run_id", "field_name", F.explode("physical_source_fields").alias("physical_field"))
    reference = references.select("run_id", "field_name", F.explode("columns").alias("_ref")).where(
        F.col("_ref").contains(".")
    )
    parts = reference.select(
        "run_id",
        "field_name",
        F.lower(F.split_part("_ref", F.lit("."), F.lit(1))).alias("alias"),
        F.regexp_extract("_ref", r"(?s)^[^.]*\.(.*)$", 1).alias("column"),
    )
    columns = alias_columns.select(
        "run_id",
        F.lower("alias").alias("alias"),
        F.lower("column").alias("_column"),
        F.concat_ws(".", "base_table", "source_column").alias("physical_field"),
    )
    through = parts.withColumn("_column", F.lower("column")).join(columns, ["run_id", "alias", "_column"])
    tables = alias_tables.select("run_id", F.lower("alias").alias("alias"), "table_name")
    beside = parts.join(tables, ["run_id", "alias"]).withColumn(
        "physical_field", F.concat_ws(".", "table_name", "column")
    )
    keys = ["run_id", "field_name", "physical_field"]
    return own.select(*keys).unionByName(through.select(*keys)).unionByName(beside.select(*keys)).distinct()


def contributions(sources: DataFrame, transformations: DataFrame) -> DataFrame:
    """Fields each source alias feeds, one row per field; a fixed text for aliases that feed none."""
    keys = [*MODULE, "source_alias"]
    fed = transformations.where(F.col("field_name").isNotNull()).select(
        *MODULE, "field_name", F.explode(F.split("origin", " / ")).alias("source_alias")
    )
    fed = fed.where((F.col("source_alias") != "") & (F.col("source_alias") != fixed.EMPTY_MARK)).distinct()
    listed = sources.select(*keys).distinct()
    found = listed.join(fed, keys, "left")
    return found.select(*keys, F.coalesce("field_name", F.lit(fixed.NO_CONTRIBUTION)).alias("field_generated"))


def steps_of_sources(sources: DataFrame, facts: Mapping[str, tuple[DataFrame, Sequence[int]]]) -> DataFrame:
    """Steps every source alias takes part in, in step order.

    ``facts`` maps a fact to the aliases it holds for and the steps it implies. Steps are
    collected as bits of one integer, so each task sends one row per alias.
    """
    keys = [*MODULE, "source_alias"]
    bits = sources.select(*keys, F.lit(0).alias("_bit"))
    for df, steps in facts.values():
        for step in steps:
            bits = bits.unionByName(df.select(*keys, F.lit(1 << step).alias("_bit")))
    marks = bits.groupBy(*keys).agg(F.bit_or("_bit").alias("_steps"), F.count_if(F.col("_bit") == 0).alias("_listed"))
    named = [F.when(F.col("_steps").bitwiseAND(1 << step) != 0, f"Paso {step}") for step in range(1, 8)]
    return marks.where("_listed > 0").select(*keys, F.array_compact(F.array(*named)).alias("used_in_steps"))


def field_steps(has_subquery: Column, has_source: Column, has_joins: Column, has_filters: Column) -> list[Column]:
    """Marks of steps 1 to 7 for a field."""
    always, never = F.lit(True), F.lit(False)
    facts = [has_subquery, has_source, has_joins, has_filters, always, always, never]
    return [F.when(fact, fixed.STEP_MARK).otherwise("").alias(f"p{step}") for step, fact in enumerate(facts, start=1)]


def traceability(fields: DataFrame, joins: DataFrame, filters: DataFrame) -> DataFrame:
    """Field by step matrix: own facts of the field, and whether its module joins or filters at all."""
    joined = joins.select(*MODULE).distinct().withColumn("_joins", F.lit(True))
    filtered = filters.select(*MODULE).distinct().withColumn("_filters", F.lit(True))
    rows = fields.join(joined, MODULE, "left").join(filtered, MODULE, "left")
    marks = field_steps(
        F.col("has_subquery"), F.col("has_source"), F.col("_joins").isNotNull(), F.col("_filters").isNotNull()
    )
    return rows.select(*MODULE, "field_name", *marks)


def classified(fields: DataFrame) -> DataFrame:
    kind, subtype = transformation_class(
        F.col("functions"),
        F.col("renamed_from"),
        F.col("field_name"),
        F.col("is_constant"),
        F.coalesce("has_aggregate", F.lit(False)),
    )
    return fields.select("run_id", "field_name", kind.alias("field_type"), subtype.alias("subtype"))


def numbered_rules(filters: DataFrame, aggregations: DataFrame, cases: DataFrame) -> DataFrame:
    """Rules of every run numbered RN-01, RN-02 …: filters, then CTE aggregations, then CASE fields."""
    united = None
    for rank, (rows, applies) in enumerate([(filters, None), (aggregations, "Paso 1"), (cases, "Paso 5")]):
        step = F.col("step") if applies is None else F.lit(applies)
        part = rows.select("run_id", F.lit(rank).alias("rank"), "pos", "description", step.alias("applies_in"))
        united = part if united is None else united.unionByName(part)
    order = [F.col("rank").asc(), F.col("pos").asc()]
    return numbered(united, ["run_id"], order, "_n").select(
        "run_id", F.concat(F.lit("RN-"), two_digits(F.col("_n"))).alias("rule_id"), "description", "applies_in"
    )


def two_digits(number: Column) -> Column:
    """At least two digits; larger numbers keep all of theirs."""
    text = number.cast("string")
    return F.when(number < 10, F.concat(F.lit("0"), text)).otherwise(text)


def module_sequence(modules: DataFrame, variables: Mapping[str, str]) -> DataFrame:
    """Modules with resolved outputs, their document role, and how deep their dependencies go.

    Modules that wait for each other in a circle share a level, and ``cycle`` names the least of them.

    ``modules`` has run_id, sequence, module_id, depends_on, output_tables, is_principal and
    final_table; ``variables`` is the configuration, a handful of values.
    """

    def resolved(text: Column) -> Column:
        for token, value in variables.items():
            text = F.replace(text, F.lit(token), F.lit(value))
        return text

    outputs = F.transform("output_tables", resolved)
    principal = F.coalesce("is_principal", F.lit(False)) | F.coalesce(
        F.array_contains(outputs, resolved(F.col("final_table"))), F.lit(False)
    )
    nodes = modules.select("run_id", F.col("module_id").alias("node"))
    needs = modules.select("run_id", F.col("module_id").alias("node"), F.explode("depends_on").alias("needed"))
    depth = levels(nodes, needs, ["run_id"]).withColumnRenamed("node", "module_id")
    return modules.join(depth, ["run_id", "module_id"]).select(
        "run_id",
        "sequence",
        "module_id",
        F.array_join("depends_on", ", ").alias("depends_on"),
        F.array_join(outputs, ", ").alias("output_tables"),
        F.when(principal, "PRINCIPAL").otherwise("STEP").alias("document_role"),
        "level",
        F.col("component").alias("cycle"),
    )
