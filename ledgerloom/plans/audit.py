"""Document audit: sections, fields, rules, SQL left in the text, names, variables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fixed_values as fixed
from ledgerloom.operators.merge import findings
from ledgerloom.session import cut

# Characters that count as white space.
SPACES = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
RULE = r"(?U)\bRN-\d{2}\b"


def required_sections(kind: Column) -> Column:
    def titles(values: list[str]) -> Column:
        return F.array(*[F.lit(value) for value in values])

    return F.when(kind == "step", titles(fixed.STEP_SECTIONS)).otherwise(titles(fixed.STRUCTURAL_SECTIONS))


# The messages of findings; those that end in a colon and space are about items.
MISSING_SECTIONS = "Faltan secciones obligatorias: "
EXTRA_SECTIONS = "Se detectaron secciones adicionales: "
MISSING_FIELDS = {"4": "Faltan campos finales en Seccion 4: ", "5": "Faltan campos finales en Seccion 5: "}
UNDEFINED_RULES = "Hay reglas referenciadas que no existen en Seccion 6: "
SQL_FOUND = "Se detectaron patrones de SQL literal en el documento: "
WRONG_NAME = f"El nombre del documento de salida debe iniciar con {fixed.DOCUMENT_PREFIX}: "
UNRESOLVED = "Quedaron variables sin resolver en el SQL: "
INFERRED = "Se resolvieron variables con valores inferidos: "


def _items(rows: DataFrame, groups: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Rows (doc_id, severity, message, item) from arrays of items by severity and message."""
    parts = [F.struct(F.lit(a).alias("severity"), F.lit(b).alias("message"), c.alias("items")) for a, b, c in groups]
    grouped = rows.select("doc_id", F.inline(F.array(*parts)))
    return grouped.select("doc_id", "severity", "message", F.explode("items").alias("item"))


def section_findings(documents: DataFrame) -> DataFrame:
    """Missing section titles (error) and additional ones (warning), one row per title."""
    required, present = required_sections(F.col("document_kind")), F.col("section_titles")
    return _items(
        documents,
        [
            ("error", MISSING_SECTIONS, F.array_except(required, present)),
            ("warning", EXTRA_SECTIONS, F.array_except(present, required)),
        ],
    )


def missing_fields(final: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """Final fields a section does not show, one row per section and field, all sections in one pass."""
    marks = final.select("doc_id", "field_name", F.lit(-1).alias("_at"))
    for at, shown in enumerate(sections.values()):
        marks = marks.unionByName(shown.select("doc_id", "field_name", F.lit(at).alias("_at")))
    seen = marks.groupBy("doc_id", "field_name").agg(
        F.bool_or(F.col("_at") == -1).alias("_final"),
        *[F.bool_or(F.col("_at") == at).alias(f"_in_{at}") for at in range(len(sections))],
    )
    absent = [F.when(~F.col(f"_in_{at}"), F.lit(name)) for at, name in enumerate(sections)]
    return seen.where("_final").select(
        "doc_id", "field_name", F.lit("error").alias("severity"),
        F.explode(F.array_compact(F.array(*absent))).alias("section"),
    )


def rule_references(documents: DataFrame) -> DataFrame:
    """Distinct rule ids named in the text of each document."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(RULE), F.lit(0)))
    return documents.where(F.col("text").contains("RN-")).select("doc_id", F.explode(found).alias("rule_id"))


def undefined_rules(documents: DataFrame, defined: DataFrame) -> DataFrame:
    """Referenced rules, from the text or listed, that no rule defines."""
    listed = documents.select("doc_id", F.explode("referenced_rule_ids").alias("rule_id"))
    named = rule_references(documents).unionByName(listed).distinct()
    return findings(named, defined, ["doc_id", "rule_id"], "error")


def sql_markers(text: Column) -> Column:
    """Sorted labels of the SQL patterns found in a lower-cased text, in which any white space counts as one space.

    Texts without a leading word, plain byte searches, are done with. The others are scanned once for all words that a
    pattern has; the two patterns that ask for one word somewhere after another compare the first place of the one with the
    last of the other among the words found. A variable is only looked ahead at, as words inside its braces count too.
    """
    lowered = F.lower(text)
    word = rf"select|from|join|on|insert(?:{SPACES}overwrite)?|compute{SPACES}stats"
    scan = F.regexp_extract_all(lowered, F.lit(rf"(?U)\b(?:{word})\b|\$\{{(?=[^}}]+\}})"), F.lit(0))
    leading = [lowered.contains(start) for start in ("compute", "insert", "join", "select", "${")]
    words = F.when(reduce(or_, leading), scan).otherwise(F.array().cast("array<string>"))

    def labels(found: Column) -> Column:
        def after(first: str, second: str) -> Column:
            begin, end = F.array_position(found, first), F.array_position(F.reverse(found), second)
            return (begin > 0) & (end > 0) & (begin < F.size(found) + 1 - end)

        hits = [
            ("compute stats", F.exists(found, lambda x: x.startswith("compute"))),
            ("insert", F.exists(found, lambda x: x.startswith("insert"))),
            ("insert overwrite", F.exists(found, lambda x: x.endswith("overwrite"))),
            ("join on", after("join", "on")),
            ("select from", after("select", "from")),
            ("variable sin resolver", F.array_contains(found, "${")),
        ]
        return F.array_compact(F.array(*[F.when(hit, label) for label, hit in hits]))

    # By way of a lambda, so that the scan is made once however many labels ask for it.
    return F.transform(F.array(words), labels)[0]


def marked_texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", sql_markers(F.col("text")).alias("markers"))


def audit_findings(
    documents: DataFrame, final: DataFrame, section_4: DataFrame, section_5: DataFrame, rules: DataFrame
) -> DataFrame:
    """All findings of every document in long form.

    A finding is one row (doc_id, severity, message) with ``item`` NULL and the number of its items; each item is a row
    of its own with the same message and no number. So a finding counts once however many items it has. ``documents``
    has doc_id, document_kind, section_titles, text, referenced_rule_ids, file_name, unresolved (array) and inferred
    (map of variable to value).
    """
    col = F.col
    pairs = F.transform(F.map_entries("inferred"), lambda entry: F.concat_ws("=", entry["key"], entry["value"]))
    none = F.array().cast("array<string>")
    required, present = required_sections(col("document_kind")), col("section_titles")
    named = F.when(~col("file_name").startswith(fixed.DOCUMENT_PREFIX), F.array("file_name")).otherwise(none)
    own = _items(
        documents,
        [
            ("error", MISSING_SECTIONS, F.array_except(required, present)),
            ("warning", EXTRA_SECTIONS, F.array_except(present, required)),
            ("error", SQL_FOUND, sql_markers(col("text"))),
            ("error", WRONG_NAME, named),
            ("error", UNRESOLVED, F.array_distinct("unresolved")),
            ("warning", INFERRED, F.when(F.size("unresolved") == 0, pairs).otherwise(none)),
        ],
    )
    missing = missing_fields(final, {"4": section_4, "5": section_5})
    message = F.when(col("section") == "4", MISSING_FIELDS["4"]).otherwise(MISSING_FIELDS["5"])
    fields = missing.select("doc_id", "severity", message.alias("message"), col("field_name").alias("item"))
    undefined = undefined_rules(documents, rules).select(
        "doc_id", "severity", F.lit(UNDEFINED_RULES).alias("message"), col("rule_id").alias("item")
    )
    items = cut(own.unionByName(fields).unionByName(undefined), "finding_items")
    heads = items.groupBy("doc_id", "severity", "message").agg(F.count("*").alias("item_count"))
    return heads.select(
        "doc_id", "severity", "message", F.lit(None).cast("string").alias("item"), "item_count"
    ).unionByName(items.withColumn("item_count", F.lit(None).cast("bigint")))


def audit_summary(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Error and warning counts of every document; it passes without errors. Items of findings do not count."""
    heads = found.where("item is null") if "item" in found.columns else found
    counts = heads.groupBy("doc_id").agg(
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
    )
    rows = documents.select("doc_id").join(counts, "doc_id", "left").na.fill(0, ["error_count", "warning_count"])
    return rows.withColumn("passed", F.col("error_count") == 0)
