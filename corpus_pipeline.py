"""The corpus pipeline over ``documents``: what is kept of each stage is written as Parquet and read by the next."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.decontaminate import decontaminate
from ledgerloom.llm.jaccard_join import jaccard_join
from ledgerloom.llm.packing import pack, with_texts
from ledgerloom.llm.quality import classify
from ledgerloom.llm.rows import without, without_rows
from ledgerloom.llm.substring_dedup import removed_from, substring_dedup
from ledgerloom.session import cut, remove_folder, run_folder, scratch_path

#: No SQL: the classifier is fitted and buckets are chosen by dynamic programming. Each stage is tested by itself.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    A row is judged by its text, so equal texts fare alike whatever their ids; NULL texts and those without words are
    rejected. Without labels only junk is; an empty table gives an empty one.
    """
    judged = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, cut(judged.where("not keep").select("doc_id", "row_hash").distinct(), "rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its 5-word shingles: the one of the smallest id.

    A row is known by its id and text, so only rows alike in text go, rows of one id with other texts stay, and rows without
    an id take part (those with one come first). Of rows equal in id and text one stays. Texts without words are no
    duplicates: such rows all stay. An empty table gives an empty one.
    """
    row_id = F.xxhash64("doc_id", "text")
    found = jaccard_join(docs.select(row_id.alias("doc_id"), "text"), shingle=5, similarity=Fraction(4, 5))
    groups = cut(found.where("n_shingles > 0").select(F.col("doc_id").alias("row_id"), "component_id"), "groups")
    sizes = groups.groupBy("component_id").agg(F.count("*").alias("rows")).where("rows > 1")
    several = groups.join(sizes, "component_id").select("row_id", "component_id").distinct()
    named = docs.select(row_id.alias("row_id"), "doc_id").distinct().join(several, "row_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    first = named.groupBy("component_id").agg(F.min_by("row_id", order).alias("first"))
    later = cut(named.join(first, "component_id").where("row_id <> first").select("row_id"), "later")
    kept = without_rows(docs, row_id, later)
    repeated = cut(groups.groupBy("row_id").agg(F.count("*").alias("rows")).where("rows > 1").select("row_id"), "repeated")
    if repeated.isEmpty():
        return kept
    keys = row_id.alias("row_id"), "doc_id", F.sha2("text", 256).alias("text_hash")
    equal = kept.select(F.struct("*").alias("row"), *keys).join(repeated, "row_id", "left_semi")
    least = equal.groupBy("row_id", "doc_id", "text_hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return without_rows(kept, row_id, repeated).unionByName(least.select("row.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows that a document of smaller id holds; wholly repeated ones go.

    Texts that lose nothing stay as they are, others become their kept words joined by single spaces. NULL texts and rows
    without an id lose nothing; rows that share an id are one document. An empty table gives an empty one.
    """
    return removed_from(docs, cut(substring_dedup(docs, window=50), "repeats"))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items.

    A row goes if over a twentieth of its words lie in windows of items, judged by its own text; NULL texts and an empty
    benchmark contaminate nothing. An empty table gives an empty one.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=13, share=20)
    return without(docs, cut(found.where("contaminated").select("doc_id", "row_hash").distinct(), "contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches: a row per piece of a document, with its text, bucket, batch and slot.

    Texts without words have no pieces. Rows equal in id and text are packed once each; an empty table gives no batches.
    """
    return with_texts(pack(docs, longest=2048, buckets=16, budget=32_768), docs).drop("row_hash")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("contamination", contamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each but the last is written to the shared folder and read again.

    Every run has a folder of its own. A stage's intermediate tables go once its result is written, and a result once the
    next one is; what the last stage has written stays, as the batches are read from it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with run_folder(spark, keep=True):
        for name, stage in STAGES[:-1]:
            path = scratch_path(spark, name)
            with run_folder(spark):
                kept = stage(spark, docs, sf_dir)
                kept.write.parquet(path)
            if before is not None:
                remove_folder(spark, before)
            before, docs = path, spark.read.schema(kept.schema).parquet(path)
        return STAGES[-1][1](spark, docs, sf_dir)
