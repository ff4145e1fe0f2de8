"""What has been imported already: a stored ledger of content hashes, and the changes against it."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators.rows import best_by
from ledgerloom.session import cut
from ledgerloom.sources.keyed import KeyedTable

KEYS = ("kind", "identity")
SCHEMA = (
    StructType().add("kind", "string").add("identity", "string").add("content_hash", "string").add("run_id", "string")
    .add("created_at", "timestamp_ntz").add("superseded", "boolean")
)


def ledger_table(spark: SparkSession, path: str, parts: int = 256, buckets: int = 256) -> KeyedTable:
    """The ledger in a folder, one row for each thing seen, in partitions by what it is."""
    return KeyedTable(spark, path, SCHEMA, KEYS, parts, buckets=buckets)


def evidence_hashes(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """One value per run for a set of rows about it, whatever their order: (run_id, evidence).

    A sum of row hashes and a count, so that a run with very many rows is no list and tasks combine theirs first.
    """
    columns = sorted(c for c in rows.columns if c != run)
    row_hash = F.xxhash64(*[F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}) for c in columns])
    total = F.sum(row_hash.cast("decimal(38,0)")).cast("string")
    return rows.groupBy(run).agg(F.concat_ws(":", F.count("*").cast("string"), total).alias("evidence"))


def observations(versions: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """What a set of contract versions shows, as ledger rows of three kinds.

    ``versions`` has run_id, table_name, created_at and contract_json; ``evidence`` a hash of what else counts for a run,
    such as its lineage and inventory. ``run``: the hash of its contract and evidence, superseded if its table has a newer
    one (by created_at, then run_id). ``table``: the hash of its newest contract. ``contract``: a text by its own hash, with
    the newest run that has it. A NULL table is a table like others.
    """
    hashed = versions.select(
        "run_id", "table_name", F.col("created_at").cast("timestamp_ntz"), F.sha2("contract_json", 256).alias("contract_hash")
    )
    own = hashed if evidence is None else hashed.join(evidence, "run_id", "left")
    content = F.col("contract_hash") if evidence is None else F.sha2(F.concat_ws("|", "contract_hash", "evidence"), 256)
    order = [F.col("created_at").desc_nulls_last(), F.col("run_id").desc_nulls_last()]
    newest = best_by(hashed, ["table_name"], order)
    leading = newest.select(F.col("run_id").alias("_run"), F.lit(False).alias("superseded"))
    runs = own.join(leading, F.col("run_id").eqNullSafe(F.col("_run")), "left").select(
        F.lit("run").alias("kind"), F.col("run_id").alias("identity"), content.alias("content_hash"), "run_id", "created_at",
        F.coalesce("superseded", F.lit(True)).alias("superseded"),
    )

    def rows(kind: str, found: DataFrame, identity: str) -> DataFrame:
        return found.select(
            F.lit(kind).alias("kind"), F.col(identity).alias("identity"), F.col("contract_hash").alias("content_hash"),
            "run_id", "created_at", F.lit(False).alias("superseded"),
        )

    contracts = best_by(hashed, ["contract_hash"], order)
    return runs.unionByName(rows("table", newest, "table_name")).unionByName(rows("contract", contracts, "contract_hash"))


def changes(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of ``seen`` that the ledger rows ``known`` do not show yet: new, changed or superseded since; nothing else."""
    before = known.select(
        *[F.col(key).alias(f"_{key}") for key in KEYS], F.col("content_hash").alias("before_hash"),
        F.col("superseded").alias("_superseded"), F.lit(True).alias("_known"),
    )
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in KEYS])
    change = (
        F.when(F.col("_known").isNull(), "new")
        .when(~F.col("before_hash").eqNullSafe(F.col("content_hash")), "changed")
        .when(F.col("superseded") & ~F.col("_superseded"), "superseded")
    )
    compared = seen.join(before, same, "left").withColumn("change", change).where("change is not null")
    return compared.select(*[field.name for field in SCHEMA], "change", "before_hash")


def take_in(ledger: KeyedTable, seen: DataFrame) -> DataFrame:
    """The changes that ``seen`` brings, after which the ledger shows them too; the same input again brings none.

    The changes are written before the ledger is, so they are the same for every reader. Only the partitions that ``seen``
    falls into are read and those of changes written.
    """
    seen = cut(seen, "seen")
    found = cut(changes(ledger.near(seen), seen), "changes")
    ledger.upsert(found.select(*[field.name for field in SCHEMA]))
    return found
