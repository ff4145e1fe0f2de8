"""Benchmark decontamination: words of documents that lie in a window of words which a benchmark item holds.

Every shard of documents (a slice of a partition, a few MB of text) gets an FM-index over its words: suffix order, the
Burrows-Wheeler sequence in a wavelet matrix, and text positions of every eighth word. The benchmark's windows are
searched backwards, all at once, by ranks; occurrences are located through the sampled positions, and their spans merged.

The index holds only what a window can match: runs of words of the benchmark's vocabulary at least as long as the
shortest window. Any other word ends a run, as the end of a document does.

Documents are neither shuffled nor split by key, so no frequent passage makes a large task. Windows are broadcast in
blocks of ``BLOCK_WINDOWS``; each block is one pass over the documents, which carry the spans and items found so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.rows import keyed
from ledgerloom.llm.words import ALNUM, Words, slices, words
from ledgerloom.session import cut

#: Windows of one broadcast: at most ``BLOCK_WINDOWS * n`` words of 8 bytes, 26 MB for n = 13.
BLOCK_WINDOWS = 250_000
#: Every so many text positions is kept with the index.
SAMPLE = 8
#: Occurrences located at once.
LOCATE = 1 << 19


class WaveletMatrix:
    """Ranks of symbols below 2**bits in a sequence."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.ones, self.zeros = [], []
        for bit in range(bits - 1, -1, -1):
            high = (symbols >> bit) & 1 == 1
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(high, out=before[1:])
            self.ones.append(before)
            self.zeros.append(int(len(symbols) - before[-1]))
            symbols = np.concatenate([symbols[~high], symbols[high]])
        self.bits = bits

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position; adds where the symbol's block begins."""
        begin = np.zeros_like(at)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            high = (symbol >> (self.bits - 1 - level)) & 1 == 1
            at = np.where(high, zeros + ones[at], at - ones[at])
            begin = np.where(high, zeros + ones[begin], begin - ones[begin])
        return at - begin

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol, begin = np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            high = ones[at + 1] > ones[at]
            at = np.where(high, zeros + ones[at], at - ones[at])
            begin = np.where(high, zeros + ones[begin], begin - ones[begin])
            symbol = 2 * symbol + high
        return symbol, at - begin


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; every 0 is a separator of its own, ordered by position."""
    cuts = np.flatnonzero(text == 0)
    rank = text + len(cuts)
    rank[cuts] = np.arange(len(cuts))
    step, n = 1, len(text)
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + len(cuts) + int(text.max(initial=0)) + 2) + behind
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if n else np.empty(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and location of patterns in a text of symbols; 0 separates runs and ends the text."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.matrix = WaveletMatrix(text[order - 1], max(1, int(symbols).bit_length()))
        run_start = np.concatenate([[True], text[:-1] == 0]) if len(text) else np.empty(0, bool)
        self.marked = (order % SAMPLE == 0) | run_start[order]
        self.position = np.where(self.marked, order, 0)[np.flatnonzero(self.marked)]
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.size = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of equally long patterns (rows, symbols from 1): numbers of those that occur, and their suffix ranges."""
        alive = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column]
            low = self.before[symbol] + self.matrix.rank(symbol, low)
            high = self.before[symbol] + self.matrix.rank(symbol, high)
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to the next kept position are counted."""
        found, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            done = self.marked[rows]
            found[open_[done]] = self.position[self.mark_rank[rows[done]]] + steps
            open_, rows = open_[~done], rows[~done]
            symbol, rank = self.matrix.access(rows)
            rows, steps = self.before[symbol] + rank, steps + 1
        return found


class Phrases:
    """Windows of benchmark items: vocabulary, patterns by length, and the items of each pattern."""

    def __init__(self, rows: list[tuple[bytes, str]]):
        ordered = sorted(set(rows))
        windows = sorted({window for window, _ in ordered})
        number = {window: i for i, window in enumerate(windows)}
        self.items = sorted({item for _, item in ordered})
        place = {item: i for i, item in enumerate(self.items)}
        of = np.array([number[window] for window, _ in ordered], np.int64)
        self.item_of = np.array([place[item] for _, item in ordered], np.int64)
        self.first_item = np.searchsorted(of, np.arange(len(windows) + 1))
        hashes = [np.frombuffer(window, np.uint64) for window in windows]
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
        sizes = np.array([len(h) for h in hashes], np.int64)
        self.shortest = int(sizes.min(initial=1 << 62))
        self.by_length = [
            (numbers, np.searchsorted(self.vocabulary, np.stack([hashes[i] for i in numbers])) + 1)
            for numbers in (np.flatnonzero(sizes == size) for size in np.unique(sizes))
        ]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for words of the vocabulary, 0 for all others."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def occurrences(self, found: Words) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Pattern numbers, word positions and length of all occurrences in a shard."""
        if not len(self.vocabulary):
            return
        symbols = self.symbols(found.hashes)
        # A separator before each text keeps runs inside their texts.
        padded = np.insert(symbols, found.first[:-1], 0)
        origin = np.insert(np.arange(len(symbols)), found.first[:-1], -1)
        breaks = np.concatenate([np.flatnonzero(padded == 0), [len(padded)]])
        keep = np.repeat(np.diff(breaks) > self.shortest, np.diff(breaks))
        if not keep.any():
            return
        # Each kept run begins with its separator; the last gets one behind it as well.
        text, origin = np.append(padded[keep], 0), np.append(origin[keep], -1)
        index = FMIndex(text, len(self.vocabulary))
        for numbers, patterns in self.by_length:
            alive, low, high = index.search(patterns)
            total = np.cumsum(high - low)
            begin = 0
            while begin < len(alive):
                base = total[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(total, base + LOCATE, "right")))
                counts = (high - low)[begin:end]
                first = np.cumsum(counts) - counts
                rows = np.arange(counts.sum()) - np.repeat(first - low[begin:end], counts)
                yield np.repeat(numbers[alive[begin:end]], counts), origin[index.locate(rows)], patterns.shape[1]
                begin = end


def _item_windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text"):
            found = words(rows.column("text"), ALNUM, fold=True)
            items, windows, of = rows.column("item").to_pylist(), [], []
            for i, count in enumerate(found.counts.tolist()):
                begin, size = int(found.first[i]), min(n, count)
                own = {found.hashes[p : p + size].tobytes() for p in range(begin, begin + count - size + 1)} if size else ()
                windows += own
                of += [items[i]] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(of, pa.string())], ["window", "item"])

    return run


def _search(phrases, carried: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: Phrases = phrases.value
        for rows in slices(batches, "text"):
            found = words(rows.column("text"), ALNUM, fold=True)
            texts, n = found.text_of, rows.num_rows
            cover = np.zeros(len(found.hashes) + 1, np.int64)
            pairs = [np.empty((0, 2), np.int64)]
            for numbers, at, size in wanted.occurrences(found):
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size, -1)
                hit = np.unique(np.stack([texts[at], numbers], axis=1), axis=0)
                counts = wanted.first_item[hit[:, 1] + 1] - wanted.first_item[hit[:, 1]]
                first = np.cumsum(counts) - counts
                at_item = np.arange(counts.sum()) - np.repeat(first - wanted.first_item[hit[:, 1]], counts)
                pairs.append(np.unique(np.stack([np.repeat(hit[:, 0], counts), wanted.item_of[at_item]], axis=1), axis=0))
            hit = np.cumsum(cover)[:-1] > 0
            before = np.concatenate([[False], hit[:-1]]) & ~np.isin(np.arange(len(hit)), found.first)
            after = np.concatenate([hit[1:], [False]]) & ~np.isin(np.arange(len(hit)) + 1, found.first)
            start, stop = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
            of = texts[start]
            spans = [[] for _ in range(n)]
            for text, a, b in zip(of.tolist(), (start - found.first[of]).tolist(), (stop - found.first[of]).tolist()):
                spans[text].append((a, b))
            items = [set() for _ in range(n)]
            for text, item in np.unique(np.concatenate(pairs), axis=0).tolist():
                items[text].add(wanted.items[item])
            if carried:
                for i, (old_spans, old_items) in enumerate(
                    zip(rows.column("spans").to_pylist(), rows.column("items").to_pylist())
                ):
                    spans[i] = _merged(spans[i] + [(s["start"], s["end"]) for s in old_spans])
                    items[i].update(old_items)
            columns = {
                "doc_id": rows.column("doc_id"),
                "row_hash": rows.column("row_hash"),
                "n_words": pa.array(found.counts.astype(np.int64)),
                "spans": pa.array([[{"start": a, "end": b} for a, b in own] for own in spans], _SPANS),
                "items": pa.array([sorted(own) for own in items], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_pydict(columns if last else columns | {"text": rows.column("text")})

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    share: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """One row per document row: doc_id, row_hash, n_words, n_hit, spans, items (sorted strings), contaminated.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is ``n`` consecutive
    words of an item, or all of a shorter item that has words; document words inside an occurrence of a window are hit,
    and ``spans`` are the merged [start, end) word ranges of them. ``items`` are the distinct ids of items whose windows
    occur, the empty string for a NULL id. A document is contaminated if some word is hit and hit words are at least one
    in ``share``. NULL and empty texts have no words; an empty benchmark hits nothing; repeated rows of either table
    change nothing else. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")
    )
    windows = cut(items.mapInArrow(_item_windows(n), "window binary, item string").distinct(), "benchmark_windows")
    blocks = -(-windows.count() // BLOCK_WINDOWS)
    rows = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    spans = "array<struct<start:int,end:int>>"
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, row_hash bigint, n_words bigint"
    if not blocks:
        rows = rows.mapInArrow(_counted, schema)
        rows = rows.withColumn("spans", F.array().cast(spans)).withColumn("items", F.array().cast("array<string>"))
    schema = f"{schema}, spans {spans}, items array<string>"
    for block in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == block)
        phrases = spark.sparkContext.broadcast(Phrases([(bytes(r[0]), r[1]) for r in own.collect()]))
        last = block == blocks - 1
        if block:
            rows = cut(rows, "searched")
        rows = rows.mapInArrow(_search(phrases, block > 0, last), schema if last else f"{schema}, text string")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return rows.withColumn("n_hit", hit).select(
        "doc_id", "row_hash", "n_words", "n_hit", "spans", "items",
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        counts = pa.array(words(rows.column("text"), ALNUM, fold=True).counts.astype(np.int64))
        yield pa.RecordBatch.from_pydict(
            {"doc_id": rows.column("doc_id"), "row_hash": rows.column("row_hash"), "n_words": counts}
        )
