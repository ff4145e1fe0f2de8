"""Inventory of SQL scripts held as (path, text): variables, headers, outputs, sources.

Facts are read with patterns, row by row in the JVM; no SQL is parsed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns that define what counts as a variable, a header, an output, a source.
VARIABLE = r"\$\{[^}]+\}"
HEADER = r"^\s*--\|\s*@([A-Z_]+):?\s*(.*)$"
HEADER_NEXT = r"^\s*--\|\s*#\s*(.*)$"
INSERT = r"(?i)insert\s+overwrite\s+table\s+([^\s(;/]+)"
CREATE_SELECT = r"(?is)create\s+table\s+([^\s(;/]+).*?\bas\s+select\b"
# Publishing statements are wider than outputs: every spelling of INSERT and of CREATE TABLE AS.
PUBLISH_INSERT = r"(?i)\binsert\s+(?:overwrite|into)\s+(?:table\s+)?([^\s(;/]+)"
PUBLISH_CREATE = r"(?is)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([^\s(;/]+).*?\bas\s+(?:with|select)\b"
STATS = r"(?i)^\s*compute\s+stats\s+([^\s;]+)"
TARGET = r"(?iU)\b(?:insert\s+overwrite\s+table|insert\s+into|create\s+table(?:\s+if\s+not\s+exists)?)\s+([a-zA-Z0-9_$.]+)"
SOURCE = r"(?iU)\b(?:from|join)\s+([a-zA-Z0-9_$.]+)"
SOURCE_WITH_VARIABLES = r"(?i)(?:from|join)\s+([a-zA-Z0-9_${}.]+)"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def tokens(text: Column) -> Column:
    """Distinct ``${…}`` tokens of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(VARIABLE), F.lit(0))))


def statements(text: Column) -> Column:
    """Statements of a script, split at semicolons outside line comments."""

    def without_semicolons(line: Column) -> Column:
        at = F.instr(line, "--")
        comment = F.translate(line.substr(at, F.length(line)), ";", " ")
        return F.when(at > 0, F.concat(line.substr(F.lit(1), at - 1), comment)).otherwise(line)

    plain = F.array_join(F.transform(F.split(text, "\n"), without_semicolons), "\n")
    return F.filter(F.transform(F.split(plain, ";"), lambda statement: F.trim(statement)), lambda statement: statement != "")


def variables(scripts: DataFrame) -> DataFrame:
    """Variable tokens per script; the distinct tokens are the merged inventory."""
    return scripts.select("path", F.explode(tokens(F.col("text"))).alias("token"))


def resolved_variables(
    scripts: DataFrame, configured: DataFrame, environment: Mapping[str, str], today: Column
) -> DataFrame:
    """Value and origin of every token: configuration, environment, today for date-like names, or none.

    ``configured`` has token and value.
    """
    name = F.regexp_extract("token", r"(?s)^\$\{(.*)\}$", 1)
    lowered = F.lower(name)
    dated = lowered.startswith("fec_") | lowered.startswith("fecha_") | lowered.endswith("_date")
    known = {key: value for key, value in environment.items() if value}
    if known:
        pairs = [F.lit(part) for pair in known.items() for part in pair]
        from_environment = F.element_at(F.create_map(*pairs), name)
    else:
        from_environment = F.lit(None).cast("string")
    rows = variables(scripts).join(configured.select("token", F.col("value").alias("_set")), "token", "left")
    inferred = F.when(dated, F.date_format(today, "yyyy-MM-dd"))
    return rows.select(
        "path",
        "token",
        F.coalesce("_set", from_environment, inferred).alias("value"),
        F.when(F.col("_set").isNotNull(), "configured")
        .when(from_environment.isNotNull(), "environment")
        .when(dated, "inferred")
        .otherwise("unresolved")
        .alias("status"),
    )


def added_variables(scripts: DataFrame, configured: DataFrame) -> DataFrame:
    """Tokens of the whole corpus that the configuration lacks."""
    return variables(scripts).select("token").distinct().join(configured.select("token"), "token", "left_anti")


def headers(scripts: DataFrame) -> DataFrame:
    """Header entries ``--| @KEY: value``; an empty value falls through to the next ``--| #`` line.

    The last entry of a key counts.
    """

    def cleaned(value: Column) -> Column:
        text = F.trim(value)
        return F.when(text.isin("#", ":", "-"), "").otherwise(text)

    def entry(lines: Column) -> Column:
        def read(line: Column, at: Column) -> Column:
            value = cleaned(F.regexp_extract(line, HEADER, 2))
            below = F.coalesce(cleaned(F.regexp_extract(F.get(lines, at + 1), HEADER_NEXT, 1)), F.lit(""))
            return F.when(
                line.contains("--|") & F.regexp_like(line, F.lit(HEADER)),
                F.struct(
                    F.regexp_extract(line, HEADER, 1).alias("key"),
                    at.alias("at"),
                    F.when(value == "", below).otherwise(value).alias("value"),
                ),
            )

        return F.array_compact(F.transform(lines, read))

    headed = scripts.where(F.col("text").contains("--|")).select("path", F.split("text", LINE_END).alias("lines"))
    entries = headed.select("path", F.inline(entry(F.col("lines"))))
    return entries.groupBy("path", "key").agg(F.max_by("value", "at").alias("value"))


def _output(statement: Column, insert: str, create: str) -> Column:
    inserted = F.regexp_extract(statement, insert, 1)
    return F.when(inserted != "", inserted).otherwise(F.regexp_extract(statement, create, 1))


def output_tables(text: Column) -> Column:
    """Distinct published tables of a script, in order."""
    found = F.transform(statements(text), lambda statement: _output(statement, INSERT, CREATE_SELECT))
    return F.array_distinct(F.filter(found, lambda table: table != ""))


def outputs(scripts: DataFrame) -> DataFrame:
    return scripts.select("path", F.posexplode(output_tables(F.col("text"))).alias("position", "table_name"))


def sources(scripts: DataFrame) -> DataFrame:
    """Distinct tables named after FROM or JOIN, without the first target, in order."""
    target = F.lower(F.regexp_extract("text", TARGET, 1))
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(SOURCE), F.lit(1)))
    kept = F.filter(found, lambda table: F.lower(table) != target)
    return scripts.select("path", F.posexplode(kept).alias("position", "table_name"))


def flow(scripts: DataFrame) -> DataFrame:
    """Script dependencies through the tables between them.

    Edges run from a script to each table it publishes and from that table to each script
    that reads it, for tables that have both. A table written and read by many scripts costs
    one edge per script, not one per pair of scripts.
    """
    written = scripts.select("path", F.explode(output_tables(F.col("text"))).alias("table_name"))
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(SOURCE_WITH_VARIABLES), F.lit(1)))
    read = scripts.select("path", F.explode(named).alias("table_name"))
    shared = written.select("table_name").distinct().join(read.select("table_name").distinct(), "table_name", "left_semi")
    into = written.join(shared, "table_name", "left_semi").select(
        F.col("path").alias("source_node"), F.col("table_name").alias("target_node"), F.lit("writes").alias("relation")
    )
    out = read.join(shared, "table_name", "left_semi").select(
        F.col("table_name").alias("source_node"), F.col("path").alias("target_node"), F.lit("reads").alias("relation")
    )
    return into.unionByName(out)


def publications(scripts: DataFrame) -> DataFrame:
    """Publishing statements of every script in order; the last is final, earlier ones intermediate."""
    parts = statements(F.col("text"))
    is_stats = F.transform(parts, lambda s: F.lower(F.regexp_extract(s, STATS, 1)))
    stats = F.filter(is_stats, lambda table: table != "")
    published = F.filter(
        F.transform(
            F.filter(parts, lambda s: F.regexp_extract(s, STATS, 1) == ""),
            lambda s: F.struct(
                F.when(F.regexp_extract(s, PUBLISH_INSERT, 1) != "", "insert_overwrite")
                .otherwise("create_table_as_select")
                .alias("statement_type"),
                _output(s, PUBLISH_INSERT, PUBLISH_CREATE).alias("target_table"),
            ),
        ),
        lambda p: p["target_table"] != "",
    )
    rows = scripts.select("path", stats.alias("stats"), published.alias("published"))
    listed = rows.select("path", "stats", F.size("published").alias("total"), F.posexplode("published").alias("at", "p"))
    return listed.select(
        "path",
        (F.col("at") + 1).alias("sequence"),
        "p.statement_type",
        "p.target_table",
        F.when(F.col("at") + 1 == F.col("total"), "final").otherwise("intermedia").alias("role"),
        F.array_contains("stats", F.lower("p.target_table")).alias("has_compute_stats"),
    )
