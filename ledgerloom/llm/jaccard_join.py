"""N-gram Jaccard join: documents whose sets of word shingles are similar, as components.

A document's distinct shingles are hashed into groups; the group counts are a point, and the overlap of two documents is
at most the sum of the smaller coordinates. Points lie in R-trees, which are searched pairwise by that bound; what
survives is verified on the whole sets. All steps are exact.

Which documents share a tree: similarity t between sets of n and n' shingles leaves at most d = n (1 - t) / t shingles in
one set only. Deal the shingles to m > d groups; then at most d groups differ, so the heaviest group that is equal on
both sides is among the d + 1 heaviest of either. A document is filed under the content of those groups (m is the power
of two above d; near a power's edge a document is filed under two of them, as its partners may be). Documents in one file
are nearly always near copies, so files are small and no frequent word or shared passage makes a large one.

Documents are first tied to the smallest one of their files, then, where that leaves them apart, to the first ones of their
other files. Only files that then still hold several components go to a tree,
where only pairs of different components matter. A pair must pass the tree's bound and a finer one, on four times as many
groups as the set has shingles: a group that one side has and the other has not takes a shingle from the minima. What passes
is nearly always similar; so a document meets its ``MET`` best partners, the links found become components, and only the
trees that left partners out and still hold what is apart come back, with four times as many partners, until none has been
left out. Thus a group of near copies costs a few verified pairs for each document and not all pairs, and nothing is capped.
A file beyond ``TREE_ROWS`` documents is searched as pairs of blocks, one task each.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.rows import BROADCAST_KEYS, fetched, keyed
from ledgerloom.llm.words import SPACED, grams, mix, slices, whole, words
from ledgerloom.session import cut

#: Text bytes handled at once.
SLICE = 1 << 20
#: Coordinates of a point.
GROUPS = 64
#: Documents of one block of a file; a tree holds at most two blocks.
TREE_ROWS = 2048
FANOUT = 16
#: Words of sketches compared at once.
SKETCH_WORDS = 1 << 20
#: Partners of a document that are verified in the first round.
MET = 4
#: What names a tree.
TREE = ["file", "block_a", "block_b"]

_GROUP_SALT, _SET_SALT, _OTHER_SALT, _SKETCH_SALT = (
    np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xAAC17D8EFA43CAB8, 0x632BE59BD9B4E019, 0x9E6C63D0876A46AF)
)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within a text, and the offsets of the texts.

    A text with fewer words than ``size``, but some, has its whole sequence as only shingle.
    """
    found = words(texts, SPACED, fold=True)
    hashed, counts = grams(found.hashes, size), found.counts
    parts, sizes = [], np.zeros(len(counts) + 1, np.int64)
    for i, n in enumerate(counts.tolist()):
        begin = int(found.first[i])
        if n >= size:
            part = np.unique(hashed[begin : begin + n - size + 1])
        elif n:
            part = mix(grams(found.hashes[begin : begin + n], n) + np.uint64(n))
        else:
            continue
        parts.append(part)
        sizes[i + 1] = len(part)
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.cumsum(sizes)


def most_different(n: int, similarity: Fraction) -> int:
    """The most shingles that a set of ``n`` and a similar set can differ by."""
    return n * (similarity.denominator - similarity.numerator) // similarity.numerator


def _levels(n: int, similarity: Fraction) -> range:
    """Powers of two: the groups that a set of ``n`` shingles is dealt to, as its similar sets are."""
    largest = n * similarity.denominator // similarity.numerator
    return range(most_different(n, similarity).bit_length(), most_different(largest, similarity).bit_length() + 1)


def _files(part: np.ndarray, similarity: Fraction) -> np.ndarray:
    """The keys of a set: contents of its heaviest groups."""
    dealt, value, keys = mix(part ^ _GROUP_SALT), mix(part ^ _SET_SALT), []
    take = most_different(len(part), similarity) + 1
    for level in _levels(len(part), similarity):
        at = (dealt & np.uint64((1 << level) - 1)).astype(np.int64)
        weight, content = np.bincount(at, minlength=1 << level), np.zeros(1 << level, np.uint64)
        np.add.at(content, at, value)
        group = np.argsort(-weight, kind="stable")[:take].astype(np.uint64)
        keys.append(mix(content[group.astype(np.int64)] + mix(group + np.uint64((level + 1) << 40))))
    return np.concatenate(keys)


def _sketch(part: np.ndarray) -> np.ndarray:
    """Which of some groups a set has, as bits; their number is a power of two, at least four times the set's size."""
    groups = max(64, 1 << (4 * len(part) - 1).bit_length()) if len(part) else 64
    bits = np.zeros(groups, np.uint8)
    bits[(mix(part ^ _SKETCH_SALT) & np.uint64(groups - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _long_lists(values: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype())))


def _signatures(size: int, similarity: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text", SLICE):
            sets, offsets = shingle_sets(rows.column("text"), size)
            counts, first, second, keys, points, sketches = np.diff(offsets), [], [], [], [], []
            for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                part = sets[begin:end]
                first.append(mix(part ^ _SET_SALT).sum(dtype=np.uint64))
                second.append(mix(part ^ _OTHER_SALT).sum(dtype=np.uint64))
                keys.append(_files(part, similarity).view(np.int64) if len(part) else np.empty(0, np.int64))
                sketches.append(_sketch(part))
                points.append(np.bincount((part & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(counts),
                    pa.array(np.array(first, np.uint64).view(np.int64)),
                    pa.array(np.array(second, np.uint64).view(np.int64)),
                    _long_lists(keys),
                    _long_lists(points, pa.int32()),
                    _long_lists(sketches),
                ],
                ["doc_id", "n_shingles", "sig_a", "sig_b", "files", "point", "sketch"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text", SLICE):
            sets, offsets = shingle_sets(rows.column("text"), size)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], ["node", "shingles"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    once = fetched(keyed(texts), needed, ["doc_id"], 2 * pairs.count())
    once = once.groupBy("doc_id", "row_hash").agg(F.first("text").alias("text"))
    sets = once.select("doc_id", "text").mapInArrow(_sets(size), "node bigint, shingles array<bigint>")
    sets = cut(sets, "shingle_sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right_set"))
    common = F.size(F.array_intersect("left_set", "right_set"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").withColumn("common", common)
    union = F.size("left_set") + F.size("right_set") - F.col("common")
    return both.where(similarity.denominator * F.col("common") >= similarity.numerator * union).select("a", "b").distinct()


class Tree:
    """Packed R-tree over points, kept as the upper corners of its nodes, leaves first."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.order = self._tiled(points, np.arange(len(points)))
        level, least, low = points[self.order], sizes[self.order], labels[self.order]
        high = low
        self.levels = [(level, least, low, high)]
        while len(level) > FANOUT:
            starts = np.arange(0, len(level), FANOUT)
            level, least = np.maximum.reduceat(level, starts), np.minimum.reduceat(least, starts)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((level, least, low, high))

    @classmethod
    def _tiled(cls, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows in tiles: halved again and again along the coordinate that spreads most."""
        if len(rows) <= FANOUT:
            return rows
        own = points[rows]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        rows = rows[np.argsort(own[:, axis], kind="stable")]
        middle = (len(rows) // 2 + FANOUT - 1) // FANOUT * FANOUT
        return np.concatenate([cls._tiled(points, rows[:middle]), cls._tiled(points, rows[middle:])])

    def pairs(self, similarity: Fraction, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows with different labels whose points allow the similarity, each once, in chunks."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        a, b = np.triu_indices(n)
        stack = [(top, a, b)]
        while stack:
            depth, a, b = stack.pop()
            if len(a) > chunk:
                stack += [(depth, a[i : i + chunk], b[i : i + chunk]) for i in range(0, len(a), chunk)]
                continue
            corner, least, low, high = self.levels[depth]
            mixed = (low[a] != high[b]) | (high[a] != low[b])
            a, b = a[mixed], b[mixed]
            bound = np.minimum(corner[a], corner[b]).sum(1, dtype=np.int64)
            both = similarity.numerator * (least[a] + least[b])
            near = bound * (similarity.numerator + similarity.denominator) >= both
            a, b = a[near], b[near]
            if depth == 0:
                yield self.order[a], self.order[b]
                continue
            below = len(self.levels[depth - 1][0])
            child = np.arange(FANOUT)
            left = np.repeat(a[:, None] * FANOUT + child, FANOUT, axis=1).ravel()
            right = np.tile(b[:, None] * FANOUT + child, (1, FANOUT)).ravel()
            keep = (left <= right) & (right < below)
            if keep.any():
                stack.append((depth - 1, left[keep], right[keep]))


def _folded(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches as rows of one width, the least of theirs: parts of a wider one are laid over each other."""
    width = min(map(len, sketches))
    return np.stack([np.bitwise_or.reduce(s.reshape(-1, width), axis=0) for s in sketches]).view(np.uint64)


def _score(a: np.ndarray, b: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, similarity: Fraction) -> np.ndarray:
    """The share that pairs can have in common by their sketches, -1 where it does not allow the similarity."""
    at_once, score = max(1, SKETCH_WORDS // sketches.shape[1]), np.empty(len(a))
    for begin in range(0, len(a), at_once):
        i, j = a[begin : begin + at_once], b[begin : begin + at_once]
        only_i = np.bitwise_count(sketches[i] & ~sketches[j]).sum(1, dtype=np.int64)
        only_j = np.bitwise_count(sketches[j] & ~sketches[i]).sum(1, dtype=np.int64)
        bound, both = np.minimum(sizes[i] - only_i, sizes[j] - only_j), sizes[i] + sizes[j]
        near = bound * (similarity.numerator + similarity.denominator) >= similarity.numerator * both
        score[begin : begin + at_once] = np.where(near, bound / both, -1.0)
    return score


def _best(pairs: list[tuple[np.ndarray, ...]], most: int, labels: np.ndarray) -> tuple[tuple[np.ndarray, ...], bool]:
    """The pairs (a, b, score) that are among the ``most`` best of the row with the larger label, and whether there were
    others.

    Each row proposes on one side only, so there are at most ``most`` pairs for each row, however large its file.
    """
    a, b, score = (np.concatenate(column) for column in zip(*pairs))
    side = np.where(labels[a] > labels[b], a, b)
    order = np.lexsort((-score, side))
    starts = np.flatnonzero(np.diff(side[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    keep = np.sort(order[place < most])
    return (a[keep], b[keep], score[keep]), len(keep) < len(a)


def _tested(group: pa.Table, nodes: np.ndarray) -> np.ndarray:
    """The pairs of rows, as one number each, that were verified before, from the partners listed with one of the two."""
    lists = group.column("known").combine_chunks()
    partner = lists.flatten().to_numpy()
    if not len(partner):
        return partner
    own = np.repeat(np.arange(len(nodes)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    order = np.argsort(nodes)
    at = order[np.minimum(np.searchsorted(nodes, partner, sorter=order), len(nodes) - 1)]
    here = nodes[at] == partner
    own, at = own[here], at[here]
    return np.minimum(own, at) * len(nodes) + np.maximum(own, at)


def _tree_join(similarity: Fraction, most: int):
    """Joins the documents of one file, or of two blocks of it, that have different labels: each with its best partners.

    Pairs verified before are left out, so that rounds do not repeat each other.
    """

    def run(group: pa.Table) -> pa.Table:
        nodes, label, block, sizes = (group.column(c).to_numpy() for c in ("node", "label", "block", "n_shingles"))
        points = group.column("point").combine_chunks().flatten().to_numpy().reshape(len(nodes), GROUPS)
        sketches = _folded([s.values.to_numpy() for s in group.column("sketch")])
        one_block = group.column("block_a")[0].as_py() == group.column("block_b")[0].as_py()
        tested = _tested(group, nodes)
        none = np.empty(0, np.int64)
        best, left_out, waiting = (none, none, none.astype(float)), False, []
        for a, b in Tree(points, sizes, label).pairs(similarity):
            across = one_block | (block[a] != block[b])
            if len(tested):
                across &= ~np.isin(np.minimum(a, b) * len(nodes) + np.maximum(a, b), tested)
            a, b = a[across], b[across]
            score = _score(a, b, sketches, sizes, similarity)
            near = score >= 0
            waiting.append((a[near], b[near], score[near]))
            if sum(len(pairs[0]) for pairs in waiting) > 1 << 18:
                best, more = _best([best, *waiting], most, label)
                waiting, left_out = [], left_out or more
        (a, b, _), more = _best([best, *waiting], most, label)
        a, b = nodes[a], nodes[b]
        ends = pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())
        tree = [group.column(c).slice(0, 1).take(pa.array(np.zeros(len(a), np.int64))) for c in TREE]
        return pa.table([*tree, *ends, pa.array(np.full(len(a), left_out or more))], [*TREE, "a", "b", "more"])

    return run


def _partners(pairs: DataFrame) -> DataFrame:
    """The pairs as lists of partners (node, known), each pair with that of its ends which has fewer.

    A document brings a few pairs along each round, so only partners of many others have many, and those keep no list.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    both = pairs.join(ends.toDF("a", "n_a"), "a").join(ends.toDF("b", "n_b"), "b")
    fewer = F.col("n_a") <= F.col("n_b")
    own, other = F.when(fewer, F.col("a")).otherwise(F.col("b")), F.when(fewer, F.col("b")).otherwise(F.col("a"))
    return both.select(own.alias("node"), other.alias("other")).groupBy("node").agg(F.collect_list("other").alias("known"))


def _held(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (file, node, label, blocks) of the files that hold several components; files with the same members once."""
    labelled = files.join(roots, "node", "left").select("file", "node", F.coalesce("root", "node").alias("label"))
    labelled = cut(labelled, "labelled")
    per_file = labelled.groupBy("file").agg(
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.count("*").alias("rows"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("same"),
    )
    mixed = per_file.where("low <> high").groupBy("rows", "same").agg(F.min("file").alias("file"))
    return labelled.join(mixed.select("file", F.ceil(F.col("rows") / TREE_ROWS).alias("blocks")), "file")


def _tree_pairs(
    held: DataFrame, opened: DataFrame | None, nodes: DataFrame, tested: DataFrame, similarity: Fraction, most: int
) -> DataFrame:
    """Pairs (a, b) of one file but different labels that the bounds allow, the best ``most`` of each document.

    Those in ``tested`` are left out. ``opened`` has the trees (file, block_a, block_b) to search, all if None. Rows name
    the tree they come from, and ``more`` says whether it has left some out.
    """
    open_rows = held.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # Block i meets every block: as the first of (i, j) for j >= i, as the second of (j, i) for j < i.
    met = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    dealt = open_rows.withColumn("other", met).select(
        "file", "node", "label", "block",
        F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"),
    )
    if opened is not None:
        dealt = dealt.join(opened, TREE, "left_semi")
    dealt = dealt.join(nodes, "node").join(_partners(tested), "node", "left")
    return dealt.groupBy(*TREE).applyInArrow(
        _tree_join(similarity, most), "file bigint, block_a int, block_b int, a bigint, b bigint, more boolean"
    )


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b, root_a, root_b) whose ends are in different components by ``roots`` (node, root)."""
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.where("root_a <> root_b").select("a", "b", "root_a", "root_b")


def _joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots of all nodes after further links, found on the few components that those join."""
    moved = cut(components(_apart(links, roots), "root_a", "root_b"), "moved").toDF("root", "to")
    kept = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return cut(kept.unionByName(moved.select(F.col("root").alias("node"), F.col("to").alias("root"))), "roots")


def _only_in(one: str, other: str) -> Column:
    """The number of groups that only the first of two sketches has; parts of a wider one are laid over each other."""
    width = F.least(F.size(one), F.size(other))

    def narrowed(sketch: str) -> Column:
        parts = F.sequence(F.lit(0), F.floor(F.size(sketch) / width).cast("int") - 1)
        laid = F.transform(
            F.sequence(F.lit(0), width - 1),
            lambda i: F.aggregate(parts, F.lit(0).cast("bigint"), lambda x, k: x.bitwiseOR(F.get(sketch, i + k * width))),
        )
        return F.when(F.size(sketch) > width, laid).otherwise(F.col(sketch))

    alone = F.zip_with(narrowed(one), narrowed(other), lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.aggregate(alone, F.lit(0), lambda total, n: total + n)


def _classes(docs: DataFrame, shingle: int, similarity: Fraction) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All rows with their shingle counts; those with shingles and an id by the least id of their set (doc_id, node); the
    files that more than one node is in (file, node, first); and the nodes in them with their points."""
    rows = cut(
        docs.mapInArrow(
            _signatures(shingle, similarity),
            "doc_id bigint, n_shingles bigint, sig_a bigint, sig_b bigint, files array<bigint>, point array<int>, "
            "sketch array<bigint>",
        ),
        "signatures",
    )
    same = ["n_shingles", "sig_a", "sig_b"]
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy(*same).agg(F.min("doc_id").alias("node"))
    named = filled.groupBy("doc_id", *same).agg(F.count("*").alias("rows")).join(classes, same)
    members = cut(named.select("doc_id", "node", *same, "rows"), "classes")
    # The rows of a set's other ids are picked out where they lie: the arrays of the nodes are neither moved nor written anew.
    gone = members.where("doc_id <> node").select("doc_id", *same)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    nodes = filled.join(gone, ["doc_id", *same], "left_anti")
    if not members.where("doc_id = node and rows > 1").isEmpty():
        nodes = nodes.dropDuplicates(["doc_id", *same])
    nodes = nodes.select(F.col("doc_id").alias("node"), "n_shingles", "files", "point", "sketch")
    filed = nodes.select(F.explode(F.array_distinct("files")).alias("file"), "node")
    shared = filed.groupBy("file").agg(F.min("node").alias("first"), F.count("*").alias("nodes")).where("nodes > 1")
    files = cut(filed.join(shared.select("file", "first"), "file"), "members")
    # Most nodes share no file: their points are not moved.
    filed_nodes = cut(files.select("node").distinct(), "filed")
    points = nodes.select("node", "n_shingles", "point", "sketch")
    points = cut(fetched(points, filed_nodes, ["node"], filed_nodes.count()), "points")
    return rows, members.select("doc_id", "node").distinct(), points, files


def _starred(files: DataFrame, nodes: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs of each node and the first one of its files that the bounds allow."""
    a_side = nodes.toDF("a", "n_a", "point_a", "sketch_a")
    b_side = nodes.toDF("b", "n_b", "point_b", "sketch_b")
    overlap = F.aggregate(F.zip_with("point_a", "point_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    finer = F.least(F.col("n_a") - _only_in("sketch_a", "sketch_b"), F.col("n_b") - _only_in("sketch_b", "sketch_a"))
    ratio, both = similarity.numerator + similarity.denominator, similarity.numerator * (F.col("n_a") + F.col("n_b"))
    return (
        files.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
        .join(b_side, "b").join(a_side, "a")
        .where(overlap * ratio >= both).where(finer * ratio >= both)
        .select("a", "b")
    )


def jaccard_join(
    docs: DataFrame, shingle: int = 5, similarity: Fraction = Fraction(4, 5), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest linked doc_id, directly or by others).

    Words are runs of non-white-space, A-Z lower-cased. Two documents link when the Jaccard similarity of their shingle
    sets is at least ``similarity``, an exact fraction. NULL or empty texts have no shingles and link with nothing, not
    even each other. Rows that share a doc_id are one document that links if any of its rows does, each row keeping its
    own n_shingles; a NULL doc_id links with nothing and has a NULL component. Other columns are ignored.
    """
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows, members, nodes, files = _classes(texts, shingle, similarity)
    tested = cut(_starred(files, nodes, similarity), "stars")
    # First the smallest of all files' first nodes; the others only where that leaves two components.
    nearest = cut(tested.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    # Rows of one id with different sets tie those together.
    several = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last")
    same_id = members.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    found = _verified(nearest, texts, shingle, similarity).unionByName(same_id)
    roots, most = cut(components(cut(found, "links"), "a", "b"), "roots"), MET
    others = cut(_apart(tested.join(nearest, ["a", "b"], "left_anti"), roots).select("a", "b"), "pairs")
    if not others.isEmpty():
        roots = _joined_roots(roots, cut(_verified(others, texts, shingle, similarity), "links"))
    opened = None
    while True:
        held = cut(_held(files, roots), "held")
        met = cut(_tree_pairs(held, opened, nodes, tested, similarity, most), "met")
        pairs = cut(met.select("a", "b").distinct(), "pairs")
        if not pairs.isEmpty():
            tested = tested.unionByName(pairs)
            roots = _joined_roots(roots, cut(_verified(pairs, texts, shingle, similarity), "links"))
        # Trees that have left none out are done; the others are searched again if their files still hold several components.
        opened = cut(met.where("more").select(*TREE).distinct(), "opened")
        if opened.isEmpty():
            break
        files = held.join(opened.select("file").distinct(), "file", "left_semi").select("file", "node")
        most *= 4
    of_doc = members.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")).distinct()
    return rows.join(of_doc, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")
    )


def similar_pairs(
    docs: DataFrame, shingle: int = 5, similarity: Fraction = Fraction(4, 5), doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) between different shingle sets, each by the smallest doc_id that has it, and the rows (doc_id, node)
    of documents with shingles and an id with that doc_id of their set.

    Every file goes to the trees and no pair is skipped for being tied already, so links are as many as there are; copies
    are never expanded into pairs. Rules on texts are those of :func:`jaccard_join`.
    """
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    _, members, nodes, files = _classes(texts, shingle, similarity)
    none = nodes.select("node", F.col("node").alias("root")).limit(0)
    untested = none.toDF("a", "b")
    met = _tree_pairs(_held(files, none), None, nodes, untested, similarity, (1 << 31) - 1)
    return _verified(cut(met.select("a", "b").distinct(), "met"), texts, shingle, similarity), members
