"""Packing: documents to token-budget batches with the least padding.

Texts are cut into pieces of at most ``longest`` tokens, so the global histogram of piece lengths has at most that many
rows and goes to the driver. Dynamic programming over it chooses the bucket boundaries that minimise padding: every piece
is padded to the smallest boundary that holds it. Inside a bucket of boundary b, consecutive pieces in the order of a hash
form batches of budget // b rows; they are numbered by range slices of the sort order, so a bucket with a third of all
pieces is spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.rows import keyed
from ledgerloom.llm.words import SPACED, slices, words
from ledgerloom.operators.rows import numbered
from ledgerloom.session import cut


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` boundaries, lengths of the histogram, of least total padding; the largest length is one.

    best[j] is the least padding of the j shortest lengths in k buckets: a last bucket from i to j pads every piece in it
    to the length j. Of equally good choices the shorter last bucket stands.
    """
    lengths = np.array(sorted(length for length, count in histogram.items() if count > 0), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[x] for x in lengths.tolist()], np.float64)
    held, filled = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    n = len(lengths)
    # padding[i, j]: lengths i to j - 1 in one bucket, for i < j.
    padding = np.full((n + 1, n + 1), np.inf)
    for j in range(1, n + 1):
        padding[:j, j] = lengths[j - 1] * (held[j] - held[:j]) - (filled[j] - filled[:j])
    best, choices = padding[0].copy(), []
    best[0] = 0
    for _ in range(min(buckets, n) - 1):
        total = best[:, None] + padding
        # The last of equal choices is the shortest last bucket.
        choice = n - np.argmin(total[::-1], axis=0)
        after = total[choice, np.arange(n + 1)]
        keep = best <= after
        choices.append(np.where(keep, -1, choice))
        best = np.where(keep, best, after)
    ends, j = [], n
    for choice in reversed(choices):
        if choice[j] >= 0:
            ends.append(int(lengths[j - 1]))
            j = int(choice[j])
    return sorted([*ends, int(lengths[j - 1])])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        counts = words(rows.column("text"), SPACED).counts.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("row_hash"), pa.array(counts)], ["doc_id", "row_hash", "n_words"]
        )


def pack(docs: DataFrame, longest: int = 2048, buckets: int = 16, budget: int = 32_768) -> DataFrame:
    """One row per piece: doc_id, row_hash, piece, start, n_tokens, bucket, batch, slot, padding.

    Tokens are runs of non-white-space of ``text``; piece p of a document has the tokens from p * ``longest`` on. A batch
    is named by its bucket (the padded length) and number, and has at most budget // bucket rows (at least one), fewer only
    in the last of a bucket. A NULL or empty text has no pieces. Repeated rows are packed each; a NULL doc_id is an id
    like others. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = keyed(docs.select("doc_id", "text")).mapInArrow(_counted, f"doc_id {kind}, row_hash bigint, n_words bigint")
    last = F.ceil(F.col("n_words") / longest).cast("int") - 1
    pieces = sized.where("n_words > 0").select(
        "doc_id", "row_hash", "n_words", F.explode(F.sequence(F.lit(0), last)).alias("piece")
    )
    start = F.col("piece").cast("bigint") * longest
    pieces = pieces.select(
        "doc_id", "row_hash", "piece", start.alias("start"),
        F.least(F.lit(longest).cast("bigint"), F.col("n_words") - start).alias("n_tokens"),
    )
    pieces = cut(pieces, "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("n_tokens").count().collect()}
    ends = boundaries(histogram, buckets)
    if not ends:
        empty = F.lit(None).cast("bigint")
        return pieces.select("*", *[empty.alias(c) for c in ("bucket", "batch", "slot", "padding")])
    bucket = F.array_min(F.filter(F.array(*[F.lit(e).cast("bigint") for e in ends]), lambda e: e >= F.col("n_tokens")))
    mixed = F.xxhash64("doc_id", "row_hash", "piece")
    dealt = pieces.select("*", bucket.alias("bucket"), mixed.alias("turn"))
    order = [F.col(c).asc() for c in ("turn", "doc_id", "row_hash", "piece")]
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    at = F.col("number") - 1
    return numbered(dealt, ["bucket"], order, "number").select(
        "doc_id", "row_hash", "piece", "start", "n_tokens", "bucket",
        F.floor(at / rows).cast("bigint").alias("batch"), F.pmod(at, rows).cast("bigint").alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )


def _piece_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        found = words(rows.column("text"), SPACED)
        starts, sizes, data = rows.column("start").to_pylist(), rows.column("n_tokens").to_pylist(), found.data.tobytes()
        texts = []
        for first, start, size in zip(found.first.tolist(), starts, sizes):
            begin, end = found.starts[first + start], found.ends[first + start + size - 1]
            texts.append(data[begin:end])
        column = pa.array(texts, pa.binary()).cast(pa.string())
        yield rows.set_column(rows.schema.get_field_index("text"), "text", column)


def with_texts(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """Packed pieces with the text of each, from its first token to its last."""
    texts = keyed(docs.select("doc_id", "text")).dropDuplicates(["doc_id", "row_hash"])
    names = texts.select(F.col("doc_id").alias("_doc"), F.col("row_hash").alias("_row"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row_hash") == F.col("_row"))
    both = packed.join(names, same).drop("_doc", "_row")
    return both.mapInArrow(_piece_texts, both.schema)
