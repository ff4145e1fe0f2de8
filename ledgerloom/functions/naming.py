"""Names, types and labels of catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed_values as fixed
from ledgerloom.functions.columns import contains_any


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def ascii_slug(col: Column, default: str = "datacontract") -> Column:
    """Lower case, runs of anything but ASCII letters and digits become one dash."""
    dashed = F.regexp_replace(F.lower(F.trim(col)), "[^a-zA-Z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit(default))


def unicode_slug(col: Column, default: str = "data_product") -> Column:
    """As :func:`ascii_slug`, but letters and digits of any script are kept."""
    dashed = F.regexp_replace(F.lower(F.trim(col)), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit(default))


def business_name(col: Column) -> Column:
    """Underscores to blanks; every run of letters starts with a capital."""
    words = F.split(F.trim(F.replace(col, F.lit("_"), F.lit(" "))), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(words, F.initcap), "")


def split_first_dot(col: Column) -> tuple[Column, Column]:
    """(schema, object) at the first dot; no schema without a dot."""
    name = F.trim(col)
    at = F.instr(name, ".")
    schema = F.when(at > 0, F.substring_index(name, ".", 1))
    rest = F.when(at > 0, name.substr(at + 1, F.length(name))).otherwise(F.nullif(name, F.lit("")))
    return schema, rest


def leaf_name(col: Column) -> Column:
    """What follows the last dot, or the whole name."""
    return F.substring_index(col, ".", -1)


def before_leaf(col: Column) -> Column:
    """What precedes the last dot; empty without a dot."""
    return F.left(col, F.greatest(F.length(col) - F.length(leaf_name(col)) - 1, F.lit(0)))


def split_last_dot(col: Column) -> tuple[Column, Column]:
    """(namespace, name) at the last dot, with the defaults of the lineage events."""
    name = F.trim(F.coalesce(col, F.lit("")))
    dotted = F.instr(name, ".") > 0
    space = F.when(dotted, before_leaf(name)).otherwise(F.lit("default"))
    leaf = F.when(dotted, leaf_name(name)).otherwise(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown")))
    return space, leaf


def physical_names(col: Column) -> Column:
    """Qualified table behind a source text as an array of one, empty for CTEs, sub-selects and lists.

    Exploding the array keeps the rows that have a name and works the name out once per row.
    """
    text = F.trim(col)
    lowered = F.lower(text)
    rejected = lowered.startswith("cte ") | contains_any(lowered, ["subconsulta", "derivada de"]) | text.contains(",")
    base = F.trim(F.split_part(text, F.lit("("), F.lit(1)))
    base = F.trim(F.split_part(base, F.lit(" AS "), F.lit(1)))
    base = F.trim(F.split_part(base, F.lit(" as "), F.lit(1)))
    named = F.filter(F.array(base), lambda name: ~name.contains(" ") & name.contains("."))
    return F.when(~rejected, named).otherwise(F.array().cast("array<string>"))


def source_tables(col: Column) -> Column:
    """Array of physical tables named in a source text, in order, without repeats."""
    listed = F.split(F.split_part(col, F.lit("(subconsulta"), F.lit(1)), ",")
    bases = F.transform(listed, lambda item: F.trim(F.split_part(F.trim(item), F.lit(" AS "), F.lit(1))))
    return F.array_distinct(F.filter(bases, lambda base: (base != "") & ~base.startswith("_")))


def layer(col: Column) -> Column:
    """Layer label from the prefix of the first table in a source text."""
    first = F.trim(F.split_part(F.trim(F.split_part(col, F.lit("("), F.lit(1))), F.lit(","), F.lit(1)))
    leaf = F.lower(leaf_name(first))
    label = F.lit(fixed.NO_LAYER)
    for prefix, text in fixed.LAYERS.items():
        label = F.when(leaf.startswith(prefix), text).otherwise(label)
    return label


def schema_group(col: Column) -> Column:
    """Diagram group of a node: raw, cd, cu, process or other."""
    lowered = F.lower(col)
    leaf = leaf_name(lowered)
    group = None
    for name, schemas, prefix in fixed.GROUP_PREFIXES:
        hit = leaf.startswith(prefix)
        for schema in schemas:
            hit = hit | lowered.startswith(schema)
        group = F.when(hit, name) if group is None else group.when(hit, name)
    return group.when(col.contains("::"), "process").otherwise("other")


def schema_type(col: Column) -> Column:
    """One of the allowed schema types; empty is unclassified, unknown is other."""
    name = F.upper(F.trim(F.coalesce(col, F.lit(""))))
    return F.when(name == "", "NO CLASIFICADO").when(name.isin(fixed.SCHEMA_TYPES), name).otherwise("OTRO")


def is_temporary(schema: Column, kind: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(schema, F.lit(""))))
    return (
        (schema_type(kind) == "TEMPORAL")
        | name.endswith("_tmp")
        | name.startswith("tmp_")
        | name.startswith("stg_")
    )


def tabular_type(col: Column) -> Column:
    """Logical type of a database type name. ``INT`` inside any word wins first."""
    name = F.upper(F.trim(col))
    return (
        F.when(name.contains("INT"), "integer")
        .when(contains_any(name, ["REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL"]), "number")
        .when(name.contains("BOOL"), "boolean")
        .when(name.contains("DATE") & ~name.contains("TIME"), "date")
        .when(name.contains("TIME"), "timestamp")
        .otherwise("string")
    )


def ddl_type(col: Column) -> Column:
    """Logical type of a DDL type, by its leading word."""
    name = F.upper(F.trim(col))
    return (
        F.when(name.rlike("^(STRING|CHAR|VARCHAR)"), "string")
        .when(name.rlike("^(INT|BIGINT|SMALLINT|TINYINT)"), "integer")
        .when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(name.rlike("^BOOLEAN"), "boolean")
        .when(name.rlike("^TIMESTAMP"), "timestamp")
        .when(name.rlike("^DATE"), "date")
        .otherwise("string")
    )


def inferred_type(name: Column, functions: Column) -> Column:
    """Logical type guessed from a field name, then from the functions that made it."""
    lowered = F.lower(name)
    guess = None
    for kind, tokens in fixed.NAME_TYPES:
        hit = contains_any(lowered, tokens)
        guess = F.when(hit, kind) if guess is None else guess.when(hit, kind)
    used = F.transform(F.coalesce(functions, F.array().cast("array<string>")), F.upper)
    counted = F.array_contains(used, "COUNT") | F.array_contains(used, "SUM")
    return guess.when(counted, "number").otherwise("string")


def transformation_class(
    functions: Column, renamed_from: Column, name: Column, constant: Column, aggregates: Column
) -> tuple[Column, Column]:
    """(D or T, subtype) of a field.

    ``renamed_from`` holds the column name when the expression is a bare column; ``aggregates`` tells that some function
    is an aggregate, which names alone cannot.
    """
    bare = renamed_from.isNotNull()
    same = F.lower(renamed_from) == F.lower(name)
    labels = [
        F.when(F.arrays_overlap(functions, F.array(*[F.lit(item) for item in group])), label)
        for label, group in fixed.SUBTYPES
    ]
    first = fixed.SUBTYPES[0]
    labels[0] = F.when(aggregates | F.arrays_overlap(functions, F.array(*[F.lit(item) for item in first[1]])), first[0])
    labels.append(F.when(constant, fixed.CONSTANT_SUBTYPE))
    joined = F.coalesce(F.nullif(F.concat_ws(" + ", *labels), F.lit("")), F.lit(fixed.DEFAULT_SUBTYPE))
    kind = F.when(bare & same, "D").otherwise("T")
    subtype = F.when(bare & same, fixed.EMPTY_MARK).when(bare, fixed.RENAME_SUBTYPE).otherwise(joined)
    return kind, subtype


def product_status(col: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    return F.when(name.isin("active", "proposed", "in development"), name).otherwise("active")


def port_type(name: Column, kind: Column, tags: Column) -> Column:
    """Kind of output port, from tags, then the source kind, then the name."""
    lowered = F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(F.array_contains(F.transform(tags, F.lower), "kafka") | lowered.contains("topic"), "Kafka")
        .when(lowered.contains("file"), "File")
        .when(F.lower(name).contains("postgres"), "PostgreSQL")
        .otherwise("Dataset")
    )


def merged_description(purpose: Column, usage: Column, limitations: Column) -> Column:
    """The three description parts under their labels, a blank line between them."""
    parts = [
        F.when(F.trim(text) != "", F.concat(F.lit(f"{label}: "), F.trim(text)))
        for label, text in (("Purpose", purpose), ("Usage", usage), ("Limitations", limitations))
    ]
    return F.concat_ws("\n\n", *parts)


def contract_file_name(table: Column) -> Column:
    safe = F.btrim(F.regexp_replace(F.trim(table), r"[^\p{L}\p{N}._-]", "_"), F.lit("._"))
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("datacontract")), F.lit(".odcs.yaml"))


def file_category(path: Column) -> Column:
    """Category of a workspace file from its first folder."""
    first = F.lower(F.split_part(path, F.lit("/"), F.lit(1)))
    return (
        F.when(first == "sql", "sql")
        .when(first == "metadata", "metadata")
        .when(first == "templates", "template")
        .when(F.lower(path) == "config.yml", "config")
        .otherwise("other")
    )
