"""SimHash near-duplicates against plain Python."""

import random

import numpy as np
import xxhash

from ledgerloom.llm import queries
from ledgerloom.llm import simhash as module
from ledgerloom.llm.components import components
from ledgerloom.llm.simhash import fingerprint, near_ties, simhash


def plain_print(text, size=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(run, seed=42) for run in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def least_linked(prints):
    """For every fingerprint the smallest position that links reach."""
    prints = np.array(prints, np.uint64)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 3).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def expected(rows):
    """doc_id, fingerprint and component of rows; rows of one id count as linked."""
    prints = [plain_print(text) for _, text in rows]
    part = least_linked(prints)
    ids = {}
    for (i, _), p in zip(rows, part):
        if i is not None:
            ids.setdefault(i, []).append(p)
    joined = list(range(len(rows)))

    def find(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for parts in ids.values():
        for p in parts[1:]:
            joined[find(p)] = find(parts[0])
    least = {}
    for (i, _), p in zip(rows, part):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return sorted(((i, f"{f:016x}", least.get(find(p))) for (i, _), f, p in zip(rows, prints, part)), key=str)


def test_fingerprint_of_long_texts_in_pieces(monkeypatch):
    rng = random.Random(3)
    for piece in (4, 30, 1 << 20):
        monkeypatch.setattr(module, "PIECE", piece)
        for n in (0, 1, 2, 3, 4, 90):
            text = "".join(rng.choice(" \t\n\v") + rng.choice(["aB", "Zé", "x" * 40, "　", "q\0"]) for _ in range(n))
            assert fingerprint(text.encode(), 3) == plain_print(text)


def test_rows_are_those_of_all_pairs(awkward):
    rows, docs = awkward
    got = simhash(docs).collect()
    assert sorted((tuple(row) for row in got), key=str) == expected(rows)


def test_dense_prints_are_cut_again(spark, monkeypatch):
    """Groups beyond the limit are indexed by further bits, with the components of all pairs."""
    monkeypatch.setattr(module, "GROUP", 128)
    rng = random.Random(11)
    places = rng.sample(range(64), 18)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << p for p in rng.sample(places, rng.randrange(9))) for _ in range(900)}
    prints |= {rng.getrandbits(64) for _ in range(300)}
    prints |= {centre ^ ((1 << 64) - 1) ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    prints = sorted(prints)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    links = near_ties(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    found = {r.node: r.root for r in components(links, "a", "b").collect()}
    by_root = {}
    for p, root in zip(signed, least_linked(prints)):
        by_root.setdefault(root, set()).add(found.get(p, p))
    assert all(len(roots) == 1 for roots in by_root.values())
    assert len({next(iter(roots)) for roots in by_root.values()}) == len(by_root)


def test_empty_table(spark):
    assert simhash(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_registered_query(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, rows[3][1] + " z")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_simhash(spark, str(tmp_path)).collect()
    assert sorted((tuple(row) for row in got), key=str) == expected(rows)
