"""Binds the jobs' input tables to the given Parquet tables, for Spark and for the SQL check.

A binding is one SELECT, written once and run by both engines; ``{name}`` refers to a given
table or to another binding. The few spellings that differ come from a dialect object. The
jobs themselves are DataFrame code; the SQL they are checked against is written separately.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.columns import aes_decoder, base64_decoder
from ledgerloom.params import Params
from ledgerloom.session import apply_settings

GIVEN = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

PARAMS = Params(
    as_of=date(2001, 8, 2),
    snapshot=date(2001, 7, 30),
    month_period="200107",
    advisor_period=200129,
    week_period=200131,
)
KEY = "0123456789abcdef"
AES_DECODER = aes_decoder(KEY)
DECODER = base64_decoder()

REFERENCE = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


class Spark:
    """Spark spellings."""

    name = "spark"

    @staticmethod
    def days(x: str) -> str:
        return f"CAST(datediff({x}, DATE '1970-01-01') AS BIGINT)"

    @staticmethod
    def protect(x: str, broken: str = "false", aes: bool = False) -> str:
        plain = f"cast({x} AS binary)"
        coded = f"base64(aes_encrypt({plain}, '{KEY}', 'ECB', 'PKCS'))" if aes else f"base64({plain})"
        return f"CASE WHEN {broken} THEN '??' || {x} ELSE {coded} END"

    @staticmethod
    def strings(*items: str) -> str:
        return f"array({', '.join(items)})"

    @staticmethod
    def field(text: str, key: str) -> str:
        return f"CAST(get_json_object({text}, '$.{key}') AS BIGINT)"

    @staticmethod
    def pair(key: str, value: str, when: str) -> str:
        return f"CASE WHEN {when} THEN map({key}, {value}) ELSE CAST(map() AS MAP<STRING, STRING>) END"

    @staticmethod
    def each(name: str, *values: int) -> str:
        return f", LATERAL explode(array({', '.join(map(str, values))})) AS each_{name}({name})"

    no_strings = "CAST(array() AS ARRAY<STRING>)"


class Duck:
    """DuckDB spellings. Protected columns hold what the decoder is to return."""

    name = "duck"

    @staticmethod
    def days(x: str) -> str:
        return f"CAST(date_diff('day', DATE '1970-01-01', CAST({x} AS DATE)) AS BIGINT)"

    @staticmethod
    def protect(x: str, broken: str = "false", aes: bool = False) -> str:
        return f"CASE WHEN {broken} THEN '{PARAMS.decode_error}' ELSE {x} END"

    @staticmethod
    def strings(*items: str) -> str:
        return f"[{', '.join(items)}]"

    @staticmethod
    def field(text: str, key: str) -> str:
        return f"CAST(json_extract_string({text}, '$.{key}') AS BIGINT)"

    @staticmethod
    def pair(key: str, value: str, when: str) -> str:
        return f"CASE WHEN {when} THEN MAP([{key}], [{value}]) ELSE MAP(CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])) END"

    @staticmethod
    def each(name: str, *values: int) -> str:
        return f", (SELECT unnest([{', '.join(map(str, values))}]) AS {name}) AS each_{name}"

    no_strings = "CAST([] AS VARCHAR[])"


Binding = Callable[[type], str]
BINDINGS: dict[str, Binding] = {}
CHECKS: dict[str, str] = {}


def references(sql: str) -> list[str]:
    return sorted(set(REFERENCE.findall(sql)))


class Lab:
    """Lazily opened tables and bindings of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        apply_settings(spark)
        self.spark = spark
        self.folder = folder
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            if name in GIVEN:
                self._open[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                sql = BINDINGS[name](Spark)
                self._open[name] = self.spark.sql(sql, **{ref: self[ref] for ref in references(sql)})
        return self._open[name]


def check_sql(sql: str) -> str:
    """A self-contained query: every binding and check it refers to becomes a CTE."""
    order: list[str] = []
    texts: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in GIVEN or name in texts:
            return
        text = CHECKS[name] if name in CHECKS else BINDINGS[name](Duck)
        texts[name] = text
        for ref in references(text):
            visit(ref)
        order.append(name)

    for ref in references(sql):
        visit(ref)
    spell = {name: name for name in [*GIVEN, *texts]}
    uses = Counter(ref for text in [sql, *texts.values()] for ref in REFERENCE.findall(text))
    kept = {name: "AS MATERIALIZED" if uses[name] > 1 else "AS" for name in order}
    parts = [f"{name} {kept[name]} (\n{texts[name].format(**spell)}\n)" for name in order]
    body = sql.format(**spell)
    return f"WITH {', '.join(parts)}\nSELECT * FROM (\n{body}\n)" if parts else body
