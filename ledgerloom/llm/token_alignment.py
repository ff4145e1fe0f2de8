"""Alignment of two tokenizers over the same texts: a byte-level BPE (A) and a piece BPE with byte fallback (B).

A text is tokenised as a whole by both. Where a shared end of tokens is followed by a space-marked token on both sides it
is an anchor; anchors cut the text into windows of token ids. A window's alignment is kept by its ids: windows of equal
ids, found by a hash and compared in whole, are aligned once for all texts that a task has at hand.

Tokens that end together overlap up to that end, so the shorter one's bytes end the longer one's. The two vocabularies thus
fix all pairs that can ever be linked: no more than both have bytes, give or take ids of equal bytes. Links are numbers in
that list, and the table of their counts has a bound that no corpus changes, so that it may be sent to every task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.words import mix, slices
from ledgerloom.session import cut

#: Text bytes tokenised at once.
SLICE = 1 << 21
#: Characters of a text after which it is cut at the next place that no token of either side can span.
PIECE = 1 << 19
#: Links looked up at once.
LINKS = 1 << 20

#: How byte-level vocabularies of this kind split words (fixed value).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words beyond this length are left to the vocabulary's own tokenizer.
_LONG_RUN = re.compile(r"\S{4096}|\s{4096}")

#: Between two letters both tokenizers begin a token with the space.
_BORDER = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_SPACE_MARK = "▁"


def _plain_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: itself if printable, else counted from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in printable]
    return {chr(byte): byte for byte in printable} | {chr(256 + i): byte for i, byte in enumerate(others)}


class Vocabulary:
    """Bytes of every id, their lengths, and which begin with a space."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(entry) for entry in entries], np.int64)
        self.spaced = np.array([entry.startswith(b" ") for entry in entries])
        self.begins = self.sizes.cumsum() - self.sizes
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a row of ids."""
        sizes = self.sizes[ids]
        return self.flat[_runs(self.begins[ids], sizes)]


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of runs one after another, each from its begin on."""
    return np.repeat(begins - sizes.cumsum() + sizes, sizes) + np.arange(int(sizes.sum()))


def _byte_encoder(file: str, entries: list[bytes]):
    """A function from texts to lists of ids for a byte-level vocabulary.

    Where ids are numbered by merge and words are split in the usual way, the same ids come out of merging by rank, which
    is several times as fast; other vocabularies are left to their own tokenizer.
    """
    with open(file, encoding="utf-8") as opened:
        stated = json.load(opened)
    vocabulary, split = stated["model"]["vocab"], stated["pre_tokenizer"]
    merged = [vocabulary["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in stated["model"]["merges"]]
    usual = split["type"] == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
    if usual and merged == sorted(merged) and stated["normalizer"] is None and not stated["model"].get("ignore_merges"):
        special = {token["id"] for token in stated["added_tokens"]}
        ranks = {entry: i for i, entry in enumerate(entries) if i not in special}
        ranked = tiktoken.Encoding("ranked", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
    else:
        ranked = None
    own = Tokenizer.from_file(file)
    own.encode_special_tokens = True

    def encode(texts: list[str]) -> list[list[int]]:
        return [
            ranked.encode_ordinary(text) if ranked and not _LONG_RUN.search(text) else own.encode(text, add_special_tokens=False).ids
            for text in texts
        ]

    return encode


def _linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All pairs of which one's bytes end the other's, ascending, each as A's id << 32 | B's id."""
    a_ids, b_ids = defaultdict(list), defaultdict(list)
    for ids, entries in ((a_ids, a), (b_ids, b)):
        for number, entry in enumerate(entries):
            ids[entry].append(number)
    ending = [(i, k) for i, entry in enumerate(a) for n in range(len(entry)) for k in b_ids.get(entry[n:], ())]
    ending += [(i, k) for k, entry in enumerate(b) for n in range(1, len(entry)) for i in a_ids.get(entry[n:], ())]
    pairs = np.array(ending, np.int64).reshape(-1, 2)
    return np.unique(pairs[:, 0] << 32 | pairs[:, 1])


class Aligner:
    """Both tokenizers, and the alignment of texts by them."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        plain, entries = _plain_bytes(), Tokenizer.from_file(byte_file).get_vocab()
        known = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            known[number] = bytes(plain[c] for c in entry)
        self.a, self.encode_bytes = Vocabulary(known), _byte_encoder(byte_file, known)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        found = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        b_entries = [
            bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace(_SPACE_MARK, " ").encode()
            for i, piece in enumerate(found)
        ]
        self.b = Vocabulary(b_entries)
        # A text may be cut at a border only if no piece goes on over a space after something else.
        self.may_cut = not any(_SPACE_MARK in piece.lstrip(_SPACE_MARK) for piece in found)
        # Tokens in writing: even numbers inside a group, odd ones at the end of its A or B tokens; B's after A's.
        self.written = [f"{i}{mark}" for i in range(len(known)) for mark in ",|"]
        self.written += [f"{i}{mark}" for i in range(len(found)) for mark in ",;"]

        self.pairs = _linkable(known, b_entries)

    def parts(self, text: str) -> list[str]:
        """The text in parts that are tokenised alike alone and in place, each without the space before it."""
        parts, begin = [], 0
        while self.may_cut and len(text) - begin > PIECE and (border := _BORDER.search(text, begin + PIECE)):
            parts.append(text[begin : border.start()])
            begin = border.end()
        return [*parts, text[begin:]]

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of every text, with a space before it, by A and B."""
        of_a, of_b = self.encode_bytes([" " + text for text in texts]), self.pieces.encode(texts, num_threads=1)
        return [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in zip(of_a, of_b)]

    def aligned(self, parts: list[str]) -> list[tuple[int, int, str, np.ndarray] | None]:
        """Of every part: its numbers of tokens, its groups in writing, its links; None where the bytes are not the text's."""
        found: list[tuple[int, int, str, np.ndarray] | None] = [None] * len(parts)
        if not parts:
            return found
        wholes, ids = [b" " + part.encode() for part in parts], self.encoded(parts)
        sizes = [(int(self.a.sizes[a].sum()), int(self.b.sizes[b].sum())) for a, b in ids]
        fit = [i for i, whole in enumerate(wholes) if sizes[i] == (len(whole), len(whole))]
        if not fit:
            return found
        a, b = (np.concatenate([ids[i][side] for i in fit]) for side in (0, 1))
        text = np.frombuffer(b"".join([wholes[i] for i in fit]), np.uint8)
        ends = np.cumsum([len(wholes[i]) for i in fit])
        wrong = (self.a.spelled(a) != text) | (self.b.spelled(b) != text)
        kinds, (writings, counts, links) = self.cut(a, b, ends)
        begins = counts.cumsum() - counts
        for i, kind, bad in zip(fit, kinds, np.split(wrong, ends[:-1])):
            if not bad.any():
                written = ";".join([writings[n] for n in kind.tolist()])
                found[i] = len(ids[i][0]), len(ids[i][1]), written, links[_runs(begins[kind], counts[kind])]
        return found

    def cut(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray):
        """The windows of texts that end at ``ends`` as numbers, and the alignment of the windows of each number."""
        a_ends, b_ends = self.a.sizes[a].cumsum(), self.b.sizes[b].cumsum()
        in_a, in_b, anchor, other = (np.zeros(ends[-1] + 1, bool) for _ in range(4))
        in_a[a_ends] = in_b[b_ends] = True
        anchor[a_ends[:-1][self.a.spaced[a[1:]]]] = True
        other[b_ends[:-1][self.b.spaced[b[1:]]]] = True
        anchor &= other
        anchor[ends] = True
        a_cuts, b_cuts = np.flatnonzero(anchor[a_ends]) + 1, np.flatnonzero(anchor[b_ends]) + 1
        kind, first = _kinds([(a, np.append(0, a_cuts)), (b, np.append(0, b_cuts))])
        a_begins, b_begins = np.append(0, a_cuts[:-1])[first], np.append(0, b_cuts[:-1])[first]
        a_sizes, b_sizes = a_cuts[first] - a_begins, b_cuts[first] - b_begins
        of_a, of_b = _runs(a_begins, a_sizes), _runs(b_begins, b_sizes)
        known = self.alignments((a[of_a], in_b[a_ends[of_a]], a_sizes), (b[of_b], in_a[b_ends[of_b]], b_sizes))
        last = np.searchsorted(a_ends[a_cuts - 1], ends) + 1
        return np.split(kind, last[:-1]), known

    def alignments(self, a_side: tuple[np.ndarray, ...], b_side: tuple[np.ndarray, ...]):
        """For every window its groups as ``a1,a2|b1;…`` and its number of links; and all links.

        A link is the number of the pair that ends a group. A side has the ids of all windows, whether each ends a group,
        and the number of ids of each window.
        """
        (a, a_last, a_sizes), (b, b_last, b_sizes) = a_side, b_side
        a_until, b_until = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        a_group, b_group = a_last.cumsum() - a_last, b_last.cumsum() - b_last
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.append(0, b_until)[a_group]] = 2 * a + a_last
        order[np.arange(len(b)) + a_until[b_group]] = 2 * (b + len(self.a.sizes)) + b_last
        written = self.written
        tokens, writings, begin = [written[n] for n in order.tolist()], [], 0
        for end in (a_sizes + b_sizes).cumsum().tolist():
            writings.append("".join(tokens[begin:end])[:-1])
            begin = end
        link_ends = np.searchsorted(a_until, a_sizes.cumsum()) + 1
        links = np.searchsorted(self.pairs, a[a_last] << 32 | b[b_last]).astype(np.int32)
        return writings, np.diff(link_ends, prepend=0), links


def _kinds(sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for every window, equal for equal ids on both sides, and the first window of every number.

    Windows are sorted by a hash of their ids, then compared with the first one of their number.
    """
    salt = 1
    while True:
        total, placed = np.uint64(0), []
        for ids, cuts in sides:
            sizes = np.diff(cuts)
            place = np.arange(len(ids)) - np.repeat(cuts[:-1], sizes)
            salt += 1
            seen = mix(ids.astype(np.uint64) + mix(place.astype(np.uint64) + np.uint64(salt << 32)))
            total = mix(total + np.add.reduceat(seen, cuts[:-1]))
            placed.append((ids, cuts, sizes, place))
        _, first, kind = np.unique(total, return_index=True, return_inverse=True)
        same = True
        for ids, cuts, sizes, place in placed:
            model = first[kind]
            same = same and bool((sizes == sizes[model]).all()) and bool((ids == ids[np.repeat(cuts[model], sizes) + place]).all())
        if same:
            return kind, first


@cache
def _aligner(byte_file: str, piece_file: str) -> Aligner:
    return Aligner(byte_file, piece_file)


_ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, groups_sha256 string, links array<int>"


def _alignments(byte_file: str, piece_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_file, piece_file)
        for rows in slices(batches, "text", SLICE):
            texts = [aligner.parts(text) if text else [] for text in rows.column("text").to_pylist()]
            found = iter(aligner.aligned([part for parts in texts for part in parts]))
            n_a, n_b, digests, links, sizes = [], [], [], [np.empty(0, np.int32)], [0]
            for parts in texts:
                of_text = [next(found) for _ in parts]
                whole = bool(parts) and None not in of_text
                n_a.append(sum(part[0] for part in of_text) if whole else 0)
                n_b.append(sum(part[1] for part in of_text) if whole else 0)
                digests.append(hashlib.sha256(";".join([p[2] for p in of_text]).encode()).hexdigest() if whole else "")
                links += [part[3] for part in of_text] if whole else []
                sizes.append(sum(len(part[3]) for part in of_text) if whole else 0)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(links)))
            counts = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *counts, lists], _ALIGNED_NAMES)

    return run


_ALIGNED_NAMES = ["doc_id", "n_a", "n_b", "groups_sha256", "links"]


def _with_counts(counts: np.ndarray, best: np.ndarray):
    """Adds to every document the number of its links that are the best of their B id, and the sum of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("links")
            offsets, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()
            n_best, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            filled = np.flatnonzero(np.diff(offsets))
            while len(filled):
                begin = offsets[filled[0]]
                take = max(1, int(np.searchsorted(offsets[filled + 1], begin + LINKS, "right")))
                now, filled = filled[:take], filled[take:]
                part = flat[begin : offsets[now[-1] + 1]]
                n_best[now] = np.add.reduceat(best[part].astype(np.int64), offsets[now] - begin)
                sums[now] = np.add.reduceat(counts[part], offsets[now] - begin)
            n_links = pa.array(np.diff(offsets))
            kept = [batch.column(name) for name in ("doc_id", "n_a", "n_b")]
            found = [n_links, n_links, pa.array(n_best), pa.array(sums), batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(
                kept + found, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            )

    return run


def aligned_texts(docs: DataFrame, byte_file: str, piece_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, groups_sha256, and its links in order, as numbers of :func:`linkable`."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return cut(texts.mapInArrow(_alignments(byte_file, piece_file), _ALIGNED), "aligned")


def linkable(byte_file: str, piece_file: str) -> tuple[np.ndarray, np.ndarray]:
    """A's and B's ids of every pair that can be linked; the number of a pair is its place."""
    pairs = _aligner(byte_file, piece_file).pairs
    return pairs >> 32, pairs & 0xFFFFFFFF


def pair_counts(aligned: DataFrame, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every pair that can be linked: how many links hold it, and whether no pair of its B id has more."""
    found = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n")).toArrow()
    counts, most = np.zeros(len(b_ids), np.int64), np.zeros(int(b_ids.max(initial=0)) + 1, np.int64)
    counts[found.column("link").to_numpy()] = found.column("n").to_numpy()
    np.maximum.at(most, b_ids, counts)
    return counts, counts == most[b_ids]


def align_tokens(docs: DataFrame, byte_file: str, piece_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``byte_file`` (A) encodes the text with a space before it, ``piece_file`` (B) adds that space itself; special tokens
    inside texts are plain text. Places where tokens of both end cut the tokens into groups, written ``a1,a2|b1;a3|b2``;
    every such place links the two tokens that end there. ``count_sum`` adds up, over the links of a document, how many
    links of all documents hold the same id pair; ``n_best`` counts links whose pair is the most frequent of its B id, ties
    included. A text that is NULL or empty, or whose bytes one side doesn't give back, has no tokens: zeros, and '' in
    place of the digest. Rows with equal or NULL ids and equal texts each count. An empty table gives no rows; other columns
    are ignored.
    """
    aligned = aligned_texts(docs, byte_file, piece_file, doc_id, text)
    counts, best = pair_counts(aligned, linkable(byte_file, piece_file)[1])
    return aligned.mapInArrow(
        _with_counts(counts, best),
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
        "groups_sha256 string",
    )
