"""LM scoring: a bigram model whose counts live in a log-frequency Bloom filter.

A count is quantised to level q = 1 + floor(log_b count); the filter holds the pairs (n-gram, 1) ... (n-gram, q). A reader
probes level after level until one is missing, so a count can only be read too high, and rarely. Probabilities come from
the counts read: the unigram estimate with one added, and the bigram estimate smoothed towards it,

    P1(w) = (c(w) + 1) / (N + V + 1)        P(w | h) = (c(h w) + K P1(w)) / (c(h) + K).

Building: documents are counted slice by slice and partition by partition; n-grams, dealt to buckets by the top bits of
their hashes, travel as one row of sorted hashes and counts per task and bucket. A bucket sums its rows and makes the
exact unigram counts and its own part of the filter, sized for what it holds. The number of buckets follows the size of
the input, so a bucket stays at a few MB, whatever its words: a frequent n-gram arrives at most once from each task.

Reading: the parts are broadcast together up to ``BROADCAST_BYTES``. A larger model is read in several passes over the
documents, each with the next parts; levels found so far travel with the documents as two bytes a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import SPACED, mix, slices, words
from ledgerloom.session import cut, setting

#: The most of a model that is broadcast at once.
BROADCAST_BYTES = 160 << 20
#: Text bytes of the corpus for each bucket.
BUCKET_BYTES = 8 << 20
#: N-grams that a task gathers before it adds them up.
GATHERED = 1 << 20
#: Text bytes handled at once.
SLICE = 1 << 20
#: Rows of text in one Arrow batch, and bytes of counts in one.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: Partitions in which a model goes to the driver, one at a time.
PIECES = 8
#: Hash functions, and bits for every pair held: fewer than one absent pair in 100 seems held.
PROBES = 7
BITS_PER_PAIR = 10.1
#: Base of the logarithm that quantises counts.
BASE = 1.5
#: Weight of the unigram estimate, in occurrences of the history.
SMOOTHING = 4.0

_END, _BEGIN = np.uint64(0x9E6C63D0876A9A47), np.uint64(0xD6E8FEB86659FD93)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_LEVEL = np.uint64(0x165667B19E3779F9)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, each ended by the end token; history hashes; offsets of the texts."""
    found = words(texts, SPACED, fold=True)
    tokens = np.insert(found.hashes, found.first[1:], _END)
    first = found.first + np.arange(len(found.first))
    history = np.empty_like(tokens)
    history[1:] = tokens[:-1]
    history[first[:-1]] = _BEGIN
    return tokens, history, first


def _bigrams(history: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(history * _PAIR + tokens)


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with their counts added up."""
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    return hashes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


_PART = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int8()), ("hashes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64())]
)
#: Kinds of counted n-grams. The begin mark counts as a unigram, as history only: the exact counts leave it out.
UNIGRAM, BIGRAM = 0, 1


def _count(bits: int):
    """Counts of n-grams as one row per bucket and kind."""

    def flush(gathered: dict[int, list], tokens: int) -> Iterator[pa.RecordBatch]:
        rows, held = {name: [] for name in _PART.names}, 0
        for kind in list(gathered):
            parts = gathered.pop(kind)
            if not parts:
                continue
            hashes, counts = _summed(*(np.concatenate(x) for x in zip(*parts)))
            del parts
            edges = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            for bucket in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[bucket], edges[bucket + 1])
                for name, value in zip(
                    _PART.names, (bucket, kind, hashes[own].tobytes(), counts[own].astype(np.int64).tobytes(), tokens)
                ):
                    rows[name].append(value)
                tokens, held = 0, held + 16 * int(edges[bucket + 1] - edges[bucket])
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict(rows, schema=_PART)
                    rows, held = {name: [] for name in _PART.names}, 0
        yield pa.RecordBatch.from_pydict(rows, schema=_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held, tokens = {UNIGRAM: [], BIGRAM: []}, 0, 0
        for rows in slices(batches, "text", SLICE):
            own, history, first = _tokens(rows.column("text"))
            tokens += len(own)
            begins = np.full(len(first) - 1, _BEGIN, np.uint64)
            for kind, hashes in ((UNIGRAM, np.concatenate([own, begins])), (BIGRAM, _bigrams(history, own))):
                gathered[kind].append(_summed(hashes, np.ones(len(hashes), np.int64)))
            held += len(gathered[BIGRAM][-1][0])
            if held > GATHERED:
                yield from flush(gathered, tokens)
                gathered, held, tokens = {UNIGRAM: [], BIGRAM: []}, 0, 0
        if held:
            yield from flush(gathered, tokens)

    return run


_MODEL = pa.schema(
    [("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("filter", pa.binary()), ("tokens", pa.int64())]
)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Levels of counts of 1 or more."""
    return (1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9)).astype(np.int64)


def estimated(levels: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level; 0 for level 0."""
    low, high = np.ceil(BASE ** (levels - 1.0)), np.maximum(np.ceil(BASE ** (levels * 1.0)) - 1, 1)
    return np.where(levels > 0, (low + np.maximum(low, high)) / 2, 0.0)


def _keys(hashes: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Double hashing of (n-gram, level): the first value and the step to each next."""
    first = mix(hashes + np.asarray(level, np.uint64) * _LEVEL)
    return first, mix(first ^ _PAIR) | np.uint64(1)


def _bit(value: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The high half of a hash value, scaled to a filter of ``size`` bits."""
    return (((value >> np.uint64(32)) * np.asarray(size, np.uint64)) >> np.uint64(32)).astype(np.int64)


def _gram_key(hashes: np.ndarray, kind: int) -> np.ndarray:
    return hashes if kind == BIGRAM else mix(hashes + _PAIR)


def _build(group: pa.Table) -> pa.Table:
    """One bucket's exact unigram counts and its part of the filter."""
    bucket, pairs, exact = group.column("bucket")[0].as_py(), [], (np.empty(0, np.uint64), np.empty(0, np.int64))
    for kind in (UNIGRAM, BIGRAM):
        own = group.filter(pc.equal(group.column("kind"), kind))
        if own.num_rows == 0:
            continue
        hashes = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in own.column("hashes")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in own.column("counts")])
        hashes, counts = _summed(hashes, counts)
        if kind == UNIGRAM:
            told = hashes != _BEGIN
            exact = hashes[told], counts[told]
        levels = quantised(counts)
        top = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
        pairs.append((np.repeat(_gram_key(hashes, kind), levels), top + 1))
    size = max(64, int(sum(len(p[0]) for p in pairs) * BITS_PER_PAIR) + 7 & ~7)
    held = np.zeros(size, bool)
    for hashes, levels in pairs:
        value, step = _keys(hashes, levels)
        for _ in range(PROBES):
            held[_bit(value, size)] = True
            value = value + step
    return pa.Table.from_pydict(
        {
            "bucket": [bucket],
            "words": [exact[0].tobytes()],
            "counts": [exact[1].tobytes()],
            "filter": [np.packbits(held, bitorder="little").tobytes()],
            "tokens": [pc.sum(group.column("tokens")).as_py()],
        },
        schema=_MODEL,
    )


class Part:
    """Some buckets of a model, as read by workers."""

    def __init__(self, bits: int, model: DataFrame):
        """Fills arrays of known size from one partition of ``model`` after another."""
        size = F.octet_length
        told = model.select("bucket", (size("words") / 8).cast("bigint"), size("filter")).orderBy("bucket").collect()
        words, held = np.cumsum([0] + [r[1] for r in told]), np.cumsum([0] + [r[2] for r in told])
        self.bits = bits
        self.words, self.counts = np.empty(words[-1], np.uint64), np.empty(words[-1], np.uint32)
        self.filter = np.empty(held[-1], np.uint8)
        #: Size in bits and first bit of each bucket's filter; size 0 for buckets of other parts.
        self.size, self.begin = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        place = {r[0]: n for n, r in enumerate(told)}
        for r in model.select("bucket", "words", "counts", "filter").coalesce(PIECES).toLocalIterator():
            n = place[r["bucket"]]
            own = slice(words[n], words[n + 1])
            self.words[own] = np.frombuffer(r["words"], np.uint64)
            counts = np.frombuffer(r["counts"], np.int64)
            if counts.max(initial=0) >= 1 << 32:
                self.counts = self.counts.astype(np.int64)
            self.counts[own] = counts
            self.filter[held[n] : held[n + 1]] = np.frombuffer(r["filter"], np.uint8)
            self.size[r["bucket"]], self.begin[r["bucket"]] = len(r["filter"]) * 8, held[n] * 8

    def exact(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of words in the training text, 0 for words not held here; ``hashes`` are sorted."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.counts[at], 0).astype(np.int64)

    def levels(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        """Levels read for n-grams; 0 for absent ones and those of other parts."""
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        size, begin = self.size[bucket], self.begin[bucket]
        found, keys = np.zeros(len(hashes), np.uint8), _gram_key(hashes, kind)
        open_, level = np.flatnonzero(size), 0
        while len(open_):
            level += 1
            value, step = _keys(keys[open_], level)
            for _ in range(PROBES):
                at = _bit(value, size[open_]) + begin[open_]
                inside = (self.filter[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                open_, value, step = open_[inside], value[inside] + step[inside], step[inside]
            found[open_] = level
        return found


def _read(part, carried: bool, totals: tuple[int, int] | None):
    """Adds what a part of the model knows of each document; with ``totals`` (N, V) the scores are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Part = part.value
        for rows in slices(batches, "text", SLICE):
            tokens, history, first = _tokens(rows.column("text"))
            sizes = np.diff(first)
            distinct, place = np.unique(np.append(tokens, _BEGIN), return_inverse=True)
            exact = model.exact(distinct)[place[:-1]]
            single = model.levels(distinct, UNIGRAM)[place]
            pairs, pair_place = np.unique(_bigrams(history, tokens), return_inverse=True)
            double = model.levels(pairs, BIGRAM)[pair_place]
            known = np.add.reduceat((exact > 0).astype(np.int64), first[:-1])
            base = np.add.reduceat(np.log10(exact + 1.0), first[:-1])
            begin = single[-1]
            single = single[:-1]
            if carried:
                known += rows.column("n_known").to_numpy()
                base += rows.column("base").to_numpy()
                single = np.maximum(single, np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("single")]))
                double = np.maximum(double, np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("double")]))
                begin = max(begin, int(rows.column("begin")[0].as_py()))
            out = {"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": pa.array(sizes)}
            out |= {"n_known": pa.array(known)}
            if totals is None:
                cut_up = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
                out |= {"base": pa.array(base), "begin": pa.array(np.full(len(sizes), begin, np.int32))}
                out |= {"single": cut_up(single), "double": cut_up(double), "text": rows.column("text")}
            else:
                n, v = totals
                before = np.empty_like(single)
                before[1:] = single[:-1]
                before[first[:-1]] = begin
                word, past = estimated(single.astype(np.float64)), estimated(before.astype(np.float64))
                both = np.minimum(estimated(double.astype(np.float64)), past)
                alone = (word + 1) / (n + v + 1)
                chance = (both + SMOOTHING * alone) / (past + SMOOTHING)
                out |= {"base_score": pa.array(base - sizes * np.log10(n + v + 1.0))}
                out |= {"score": pa.array(np.add.reduceat(np.log10(chance), first[:-1]))}
            yield pa.RecordBatch.from_pydict(out)

    return run


def lm_score(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are runs of non-white-space, A-Z lower-cased, then one end. The model learns from the rows for which the
    column ``held_out`` is not true. ``n_known`` counts tokens that occur in the training text; ``base_score`` is the sum
    of log10((c + 1) / (N + V + 1)) with exact counts, ``score`` the model's log10 probability. A NULL or empty text is
    an end token only; without training rows N and V are 0. Repeated rows count and are scored each time; a row without
    doc_id is trained on and scored like any other. Other columns are ignored.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(doc_id).alias("doc_id"), held, F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (size // BUCKET_BYTES).bit_length())
    counted = rows.where("not held_out").select("text").mapInArrow(
        _count(bits), "bucket int, kind tinyint, hashes binary, counts binary, tokens bigint"
    )
    model = counted.groupBy("bucket").applyInArrow(
        _build, "bucket int, words binary, counts binary, filter binary, tokens bigint"
    )
    # Texts come in small batches: a batch is held by the executor and its Python worker at once.
    small_batches = "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)
    with setting(spark, *small_batches):
        model = cut(model, "model")
    held_bytes = F.octet_length("words") + F.octet_length("counts") + F.octet_length("filter")
    total, n, v = model.agg(
        F.sum(held_bytes), F.sum("tokens"), F.sum(F.octet_length("words") / 8).cast("bigint")
    ).first()
    parts = 1
    while True:
        part = F.floor(F.col("bucket") * parts / (1 << bits))
        most = model.groupBy(part.alias("part")).agg(F.sum(held_bytes).alias("size")).agg(F.max("size")).first()[0]
        if parts >= 1 << bits or (most or 0) <= BROADCAST_BYTES:
            break
        parts *= 2
    kind = docs.schema[doc_id].dataType.simpleString()
    common = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint"
    for number in range(parts):
        last = number == parts - 1
        own = Part(bits, model.where(part == number))
        rows = rows.mapInArrow(
            _read(spark.sparkContext.broadcast(own), number > 0, (n or 0, v or 0) if last else None),
            f"{common}, base_score double, score double" if last
            else f"{common}, base double, begin int, single binary, double binary, text string",
        )
        with setting(spark, *small_batches):
            rows = cut(rows, "scored")
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n or 0).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
