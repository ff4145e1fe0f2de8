"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A slice of rows is one flat byte buffer. A word is a maximal run of bytes that a 256-entry class table marks, and it is
known by a 64-bit hash: a polynomial over random byte values, taken from running sums, then mixed. UTF-8 keeps this exact
for the word classes used here, whose members outside ASCII are "every non-ASCII character".
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; a longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
#: Bytes hashed at once; the tables of powers have this length.
BLOCK = 1 << 16

SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _VALUES.copy()
_FOLDED[0x41:0x5B] = _VALUES[0x61:0x7B]
_BYTE_BASE = 0x5851F42D4C957F2D
_GRAM_BASES = (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _TABLES or len(_TABLES[base][0]) < n:
        size = max(BLOCK + 1, 1 << (n - 1).bit_length()) if n <= 1 << 22 else n
        made = _powers(base, size)
        if n > 1 << 22:
            return made
        _TABLES[base] = made
    return _TABLES[base]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = int(ends[j - 1])
        up, down = _table(_BYTE_BASE, int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges in ascending order, A-Z as a-z."""
    return _hashes(data, starts, ends, _FOLDED)


@dataclass
class Words:
    """Words of some texts: byte ranges in ``data``, hashes, and ``first[i]:first[i + 1]`` for the words of text i."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The text number of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; NULL counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    plain = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    if len(plain) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffer = plain.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, kind: np.ndarray = SPACED, fold: bool = True) -> Words:
    """The words of every text; ``fold`` hashes A-Z as a-z."""
    data, offsets = flat(texts)
    inside = kind[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    if len(data):
        before[0] = after[-1] = False
        edges = edges[(edges > 0) & (edges < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = _hashes(data, starts, ends, _FOLDED if fold else _VALUES)
    return Words(data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes; ``which`` picks one of two independent hashes."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    up, down = _table(_GRAM_BASES[which], len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    source = hashes if which == 0 else mix(hashes + np.uint64(which))
    np.cumsum(source * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def whole(first: np.ndarray, n: int) -> np.ndarray:
    """Positions at which a run of ``n`` words stays inside its text."""
    at = np.arange(max(0, int(first[-1]) - n + 1))
    left = np.repeat(first[1:], np.diff(first))[: len(at)] - at
    return at[left >= n]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose texts together stay near ``limit`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
