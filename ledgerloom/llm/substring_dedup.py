"""Substring dedup: words inside a window of words that an earlier document also holds are removed.

Level-wise doubling: windows of a short length are counted first, and only where one is repeated in another document is
it extended to twice its length, until the wanted length is reached or no candidate survives. At the shortest length L
not every window needs counting: a window of 2 L words holds L + 1 windows of L words, and equal windows have their least
one (by hash) at the same place, so a repeated window of 2 L words always shares that one. About 2 windows in L + 2 are
least anywhere.

Documents whose word sequences are equal are settled first: all but the smallest lose every word, as each of their
windows starts in that one too. Counting is an aggregate with partial results joined back to its rows, so a passage that
a third of all documents hold is one skewed join key that Spark splits, never a group in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.rows import BROADCAST_KEYS, fetched, keyed
from ledgerloom.llm.words import SPACED, Words, grams, mix, slices, whole, words
from ledgerloom.session import cut

#: Text bytes handled at once.
SLICE = 1 << 20
#: Windows are not counted at lengths below this.
SHORTEST = 16


def lengths(window: int) -> list[int]:
    """The lengths counted, each twice the one before, ending in ``window``."""
    found = [window]
    while found[0] % 2 == 0 and found[0] // 2 >= SHORTEST:
        found.insert(0, found[0] // 2)
    return found


def _least_windows(found: Words, length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of ``length + span - 1`` words: their positions, and position and hash of the least inner window."""
    hashed = grams(found.hashes, length)
    at = whole(found.first, length + span - 1)
    if len(at) == 0:
        return at, at, np.empty(0, np.uint64)
    if span == 1:
        return at, at, hashed[at]
    view = np.lib.stride_tricks.sliding_window_view(hashed, span)
    least = at + view[at].argmin(1)
    return at, least, hashed[least]


def joined(found: Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of every text, joined by one space."""
    kept = np.flatnonzero(keep)
    texts = found.text_of[kept]
    last = np.ones(len(kept), bool)
    last[:-1] = texts[1:] != texts[:-1]
    mask = np.zeros(len(found.data) + 1, np.int8)
    np.add.at(mask, found.starts[kept], 1)
    np.add.at(mask, found.ends[kept], -1)
    inside = np.cumsum(mask, dtype=np.int8)
    inside[found.ends[kept[~last]]] = 1
    chosen = np.append(found.data, np.uint8(32))
    chosen = np.where(SPACED[chosen], chosen, np.uint8(32))[inside.astype(bool)]
    lengths_of = (found.ends - found.starts)[kept] + ~last
    ends = np.cumsum(np.bincount(texts, weights=lengths_of, minlength=len(found.first) - 1).astype(np.int64))
    flat = chosen.tobytes()
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _overview(length: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text", SLICE):
            found = words(rows.column("text"), SPACED, fold=False)
            texts, counts = found.text_of, found.counts
            place = np.arange(len(found.hashes)) - found.first[texts]
            sequence = []
            for salt in (1, 2):
                term = mix(found.hashes + mix((place.astype(np.uint64) << np.uint64(2)) + np.uint64(salt)))
                total = np.zeros(len(counts), np.uint64)
                np.add.at(total, texts, term)
                sequence.append(pa.array(total.view(np.int64)))
            _, least, hashed = _least_windows(found, length, span)
            least, once = np.unique(least, return_index=True)
            hashed = hashed[once]
            offsets = np.searchsorted(least, found.first).astype(np.int32)
            shas = [hashlib.sha256(text).hexdigest() for text in joined(found, np.ones(len(texts), bool))]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("row_hash"),
                    pa.array(counts.astype(np.int64)),
                    *sequence,
                    pa.array(shas, pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed.view(np.int64))),
                    pa.ListArray.from_arrays(
                        pa.array(offsets), pa.array((least - found.first[texts[least]]).astype(np.int32))
                    ),
                ],
                ["doc_id", "row_hash", "n_words", "seq_a", "seq_b", "kept_sha256", "hashes", "places"],
            )

    return run


def _spots(rows: pa.RecordBatch, found: Words) -> np.ndarray:
    """Marks of the words at the places listed in ``spots``."""
    lists = rows.column("spots")
    texts = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    marks = np.zeros(len(found.hashes) + 1, bool)
    marks[found.first[texts] + lists.flatten().to_numpy()] = True
    return marks


def _windows(length: int, shorter: int, least: bool):
    """Windows of ``length`` words that survived at ``shorter``: by their least inner window, or by both halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text", SLICE):
            found = words(rows.column("text"), SPACED, fold=False)
            marks = _spots(rows, found)
            if least:
                at, inner, _ = _least_windows(found, shorter, length - shorter + 1)
                at = at[marks[inner]]
            else:
                at = whole(found.first, length)
                at = at[marks[at] & marks[at + shorter]]
            texts = found.text_of[at]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(pa.array(texts)),
                    rows.column("row_hash").take(pa.array(texts)),
                    pa.array((at - found.first[texts]).astype(np.int32)),
                    pa.array(grams(found.hashes, length)[at].view(np.int64)),
                    pa.array(grams(found.hashes, length, 1)[at].view(np.int64)),
                ],
                ["doc_id", "row_hash", "place", "window_a", "window_b"],
            )

    return run


def _covered(found: Words, marks: np.ndarray, window: int) -> np.ndarray:
    """Marks of the words inside a window that starts at a marked word."""
    steps = np.zeros(len(found.hashes) + window + 1, np.int64)
    at = np.flatnonzero(marks)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return np.cumsum(steps)[: len(found.hashes)] > 0


def _removals(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text", SLICE):
            found = words(rows.column("text"), SPACED, fold=False)
            gone = _covered(found, _spots(rows, found), window)
            removed = np.bincount(found.text_of[gone], minlength=rows.num_rows).astype(np.int64)
            edge = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]) | _starts(found) & gone)
            stop = np.flatnonzero(gone & ~np.concatenate([gone[1:], [False]]) | _last(found) & gone) + 1
            texts = found.text_of[edge]
            offsets = np.searchsorted(edge, found.first).astype(np.int32)
            spans = pa.StructArray.from_arrays(
                [pa.array((x - found.first[texts]).astype(np.int32)) for x in (edge, stop)], ["start", "end"]
            )
            shas = [hashlib.sha256(text).hexdigest() for text in joined(found, ~gone)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("row_hash"),
                    pa.array(removed),
                    pa.ListArray.from_arrays(pa.array(offsets), spans),
                    pa.array(shas, pa.string()),
                ],
                ["doc_id", "row_hash", "n_removed", "removed", "kept_sha256"],
            )

    return run


def _starts(found: Words) -> np.ndarray:
    marks = np.zeros(len(found.hashes) + 1, bool)
    marks[found.first[:-1]] = True
    return marks[:-1]


def _last(found: Words) -> np.ndarray:
    marks = np.zeros(len(found.hashes) + 1, bool)
    marks[found.first[1:]] = True
    return marks[1:]


SPANS = "array<struct<start:int,end:int>>"


def substring_dedup(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, row_hash, n_words, n_removed, removed (word spans), kept_sha256.

    Words are runs of non-white-space, unchanged. A word is removed if a window of ``window`` consecutive words that
    covers it also starts in a document with a smaller doc_id, as the texts were given; kept_sha256 is taken over the kept
    words joined by one space. NULL and empty texts have no words. Rows that share a doc_id never remove each other's
    words; equal rows have equal results. A row without doc_id removes nothing and loses nothing. Other columns are
    ignored. ``row_hash`` tells apart the rows of one doc_id (:func:`ledgerloom.llm.rows.keyed`).
    """
    steps = lengths(window)
    span = steps[1] - steps[0] + 1 if len(steps) > 1 else 1
    texts = keyed(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    rows = cut(
        texts.mapInArrow(
            _overview(steps[0], span),
            "doc_id bigint, row_hash bigint, n_words bigint, seq_a bigint, seq_b bigint, kept_sha256 string,"
            " hashes array<bigint>, places array<int>",
        ),
        "overview",
    )
    long = rows.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    same = ["n_words", "seq_a", "seq_b"]
    classes = long.groupBy(*same).agg(F.min("doc_id").alias("doc_id"))
    first = long.join(classes, ["doc_id", *same], "left_semi").dropDuplicates(["doc_id", "row_hash"])
    counted = first.select("doc_id", "row_hash", F.inline(F.arrays_zip("hashes", "places"))).toDF(
        "doc_id", "row_hash", "window_a", "place"
    )
    counted = counted.withColumn("window_b", F.lit(0).cast("bigint"))
    length, row = steps[0], ["doc_id", "row_hash"]
    for longer in steps[1:]:
        spots = _shared(counted).groupBy("doc_id", "row_hash").agg(F.collect_list("place").alias("spots"))
        spots = cut(spots, "spots")
        texts = fetched(texts, spots, row, spots.count()).dropDuplicates(row)
        candidates = cut(texts.join(spots, row), "candidates")
        texts = candidates.drop("spots")
        counted = cut(
            candidates.mapInArrow(
                _windows(longer, length, length == steps[0]),
                "doc_id bigint, row_hash bigint, place int, window_a bigint, window_b bigint",
            ),
            "windows",
        )
        length = longer
    hits = _shared(counted).where("doc_id > low").groupBy("doc_id", "row_hash").agg(F.collect_list("place").alias("spots"))
    touched = texts.dropDuplicates(row).join(hits, row)
    lost = touched.mapInArrow(
        _removals(window), f"doc_id bigint, row_hash bigint, n_removed bigint, removed {SPANS}, kept_sha256 string"
    )
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    copies = (
        long.select("doc_id", "row_hash", *same)
        .join(classes.withColumnRenamed("doc_id", "low"), same)
        .where("doc_id > low")
        .select(
            "doc_id", "row_hash", F.col("n_words").alias("n_removed"), everything.cast(SPANS).alias("removed"),
            F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"),
        )
        .distinct()
    )
    changes = lost.unionByName(copies).withColumnRenamed("kept_sha256", "changed_sha256")
    return rows.select("doc_id", "row_hash", "n_words", "kept_sha256").join(
        changes, ["doc_id", "row_hash"], "left"
    ).select(
        "doc_id",
        "row_hash",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("removed", F.array().cast(SPANS)).alias("removed"),
        F.coalesce("changed_sha256", "kept_sha256").alias("kept_sha256"),
    )


def _shared(counted: DataFrame) -> DataFrame:
    """Windows that start in two documents or more, with the smallest (``low``)."""
    key = ["window_a", "window_b"]
    ends = counted.groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
    return counted.join(ends.drop("high"), key)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text", SLICE):
        found = words(rows.column("text"), SPACED, fold=False)
        lists = rows.column("removed")
        texts = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        spans = lists.flatten()
        steps = np.zeros(len(found.hashes) + 1, np.int64)
        np.add.at(steps, found.first[texts] + spans.field("start").to_numpy(), 1)
        np.add.at(steps, found.first[texts] + spans.field("end").to_numpy(), -1)
        kept = pa.array(joined(found, np.cumsum(steps)[: len(found.hashes)] == 0), pa.binary()).cast(pa.string())
        text = pc.if_else(lists.is_valid(), kept, rows.column("text").cast(pa.string()))
        yield pa.RecordBatch.from_arrays([rows.column("row"), text], ["row", "text"])


def removed_from(docs: DataFrame, results: DataFrame) -> DataFrame:
    """The documents with changed texts: kept words joined by one space where words were removed, else as given.

    A document that loses every word goes. Columns are those of ``docs``, which has its ids in doc_id and texts in text. Only
    documents that lose words are taken out of their place.
    """
    spans = cut(
        results.where("n_removed > 0")
        .select("doc_id", "row_hash", "removed", (F.col("n_removed") >= F.col("n_words")).alias("gone"))
        .dropDuplicates(["doc_id", "row_hash"]),
        "changed",
    )
    few = spans.count() <= BROADCAST_KEYS
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    rows = keyed(docs.select(others, F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    keys = spans.select("doc_id", "row_hash")
    keys, lost = F.broadcast(keys) if few else keys, spans.where("not gone").drop("gone")
    untouched = rows.join(keys, ["doc_id", "row_hash"], "left_anti").select("row", "text")
    touched = rows.join(keys, ["doc_id", "row_hash"], "left_semi") if few else rows
    packed = touched.join(lost, ["doc_id", "row_hash"]).select("row", "text", "removed")
    kept = untouched.unionByName(packed.mapInArrow(_without, untouched.schema))
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
