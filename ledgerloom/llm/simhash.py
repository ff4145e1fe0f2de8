"""SimHash near-duplicates: fingerprints that differ in few bits, found by deletion-variant signatures.

Three differing bits over two 32-bit segments leave one segment with at most one of them. So a fingerprint is indexed
under each segment as it is and under each segment with one bit left out; fingerprints that meet under an equal variant
are compared in whole. A variant is a mask of the bits it fixes, and its key a hash of mask and masked fingerprint: a
collision only adds a comparison.

Groups of equal keys. Two members are a pair of one aggregate row. Up to ``GROUP`` members are compared inside a task,
which ties each member to the first of its component and makes no list of pairs. Of a larger group the bits not yet fixed are cut and indexed
again in the same way, half as wide: whatever the data are, groups of the third cut have at most 8 free bits and 3 left
out, hence ``GROUP`` different fingerprints. No group is capped and none is compared in pairs without a bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.rows import fetched
from ledgerloom.llm.words import slices
from ledgerloom.session import cut

#: The most differing bits of linked fingerprints; two segments need at most one of them in one segment.
DIFFERENT = 3
#: The most members of a key that are compared with each other: 8 free bits and 3 left out.
GROUP = 1 << 11
#: Bytes of a text whose words are in memory at once.
PIECE = 1 << 20
SEED = 42

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _word_runs(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Words of a text, A-Z lower-cased, in runs of ``size`` or more that overlap by ``size`` - 1; fewer are one run."""
    begin, kept, short = 0, [], True
    while begin < len(text):
        space = _SPACE.search(text, begin + PIECE) if begin + PIECE < len(text) else None
        end = space.start() if space else len(text)
        kept += text[begin:end].lower().split()
        if len(kept) >= size:
            yield kept
            kept, short = kept[len(kept) - size + 1 :], False
        begin = end
    if short and kept:
        yield kept


def fingerprint(text: bytes, size: int) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without words."""
    ones, total, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    for words in _word_runs(text, size):
        joined = b" ".join(words)
        ends = np.cumsum([len(word) + 1 for word in words]) - 1
        last = ends[min(size, len(words)) - 1 :]
        starts = [0, *(ends[: len(last) - 1] + 1).tolist()]
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, last.tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text"):
            texts = rows.column("text").cast(pa.large_binary()).to_pylist()
            found = np.array([fingerprint(text or b"", size) for text in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _indexed(rows: DataFrame, width: int) -> DataFrame:
    """Rows (fp, fixed, free) under every variant of the two segments of their free bits.

    ``fixed`` masks the bits of earlier segments, the free bits are the ``width`` bits from ``free`` on. The result has
    the key of the variant, its mask, the first bit that is still free, and the value of the bit left out.
    """
    half = width // 2
    variants = []
    for segment in (0, half):
        whole = ((1 << half) - 1) << segment
        for wild in (0, *(1 << bit for bit in range(segment, segment + half))):
            variants.append(
                F.struct(
                    F.lit(_signed(whole & ~wild)).cast("bigint").alias("mask"),
                    F.lit(_signed(wild)).cast("bigint").alias("wild"),
                    F.lit(half - segment).cast("int").alias("rest"),
                )
            )
    each = rows.select("fp", "fixed", "free", F.explode(F.array(*variants)).alias("v"))
    masked = each.select(
        "fp",
        F.expr("fixed | shiftleft(v.mask, free)").alias("fixed"),
        F.expr("free + v.rest").alias("free"),
        F.expr("if(v.wild = 0, null, int(fp & shiftleft(v.wild, free) <> 0))").alias("bit"),
    )
    return masked.withColumn("key", F.xxhash64("fixed", F.col("fixed").bitwiseAND(F.col("fp"))))


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DIFFERENT


def spanning_ties(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What near fingerprints of equal, adjacent keys tie together: a row and the first one of its component."""
    label = np.arange(len(keys))
    at, step = label[:-1], 1
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        near = np.bitwise_count(prints[at] ^ prints[at + step]) <= DIFFERENT
        a, b = at[near], at[near] + step
        while True:
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            apart = low < high
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(label, high[apart], low[apart])
            while (label[label] != label).any():
                label = label[label]
        step += 1
    tied = label != np.arange(len(keys))
    return prints[tied], prints[label[tied]]


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties of the groups of a partition sorted by key; a group at a batch's end waits for the next batch."""

    def tied(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = spanning_ties(keys, prints.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keys = prints = np.empty(0, np.int64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        prints = np.concatenate([prints, batch.column("fp").to_numpy()])
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if whole:
            yield tied(keys[:whole], prints[:whole])
            keys, prints = keys[whole:], prints[whole:]
    if len(keys):
        yield tied(keys, prints)


def near_ties(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of values of the column ``fp`` (distinct) that tie together exactly what links of near ones do."""
    rows = prints.select("fp", F.lit(0).cast("bigint").alias("fixed"), F.lit(0).alias("free"))
    links, width = None, 64
    while True:
        index = _indexed(rows, width)
        groups = index.groupBy("key").agg(
            F.count("*").alias("size"), F.sum("bit").alias("ones"), F.min("fp").alias("a"), F.max("fp").alias("b")
        )
        # Members that agree in the bit left out also meet under the whole segment.
        groups = cut(groups.where("size > 1 and (ones is null or ones between 1 and size - 1)"), "groups")
        pairs = groups.where("size = 2").where(_near("a", "b")).select("a", "b")
        small = groups.where(F.col("size").between(3, GROUP)).select("key")
        met = fetched(index.select("key", "fp"), small, ["key"], small.count())
        tied = met.repartition("key").sortWithinPartitions("key").mapInArrow(_tie, "a bigint, b bigint")
        found = cut(pairs.unionByName(tied), "near")
        links = found if links is None else links.unionByName(found)
        large = groups.where(F.col("size") > GROUP).select("key")
        if large.isEmpty():
            return links
        rows = cut(index.join(large, "key").select("fp", "fixed", "free"), "crowded")
        width //= 2


def simhash(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest linked doc_id).

    Words are runs of non-white-space, A-Z lower-cased. A bit of the fingerprint is set where over half of the shingles'
    XXH64 hashes (seed 42) have it; fewer words than a shingle are one shingle. NULL, empty and blank texts have
    fingerprint zero and link like any other. Documents link when their fingerprints differ in at most three bits,
    directly or by others. Rows that share a doc_id count as linked, each keeping its own fingerprint; rows without one
    link by their fingerprints, and a component in which no row has an id is NULL. An empty table gives no rows; other
    columns are ignored.
    """
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = cut(texts.mapInArrow(_fingerprints(shingle), "doc_id bigint, fp bigint"), "fingerprints")
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    same_id = rows.join(several.where("a <> b").select("doc_id", "a"), "doc_id").select("a", F.col("fp").alias("b"))
    tied = components(near_ties(prints).unionByName(same_id), "a", "b")
    named = prints.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(of_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
