"""Operators on documents against plain Python, on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate as decontamination
from ledgerloom.llm import jaccard_join as joining
from ledgerloom.llm import lm_score as scoring
from ledgerloom.llm.substring_dedup import lengths, removed_from, substring_dedup


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


def alnum(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower(text))


# ---------------------------------------------------------------- n-gram Jaccard join


def linked(rows, size, similarity):
    """Shingle counts of rows, and the smallest id reachable by links."""
    sets = []
    for _, text in rows:
        words = spaced(lower(text))
        runs = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        sets.append(runs if len(words) >= size else {tuple(words)} if words else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            if Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= similarity:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for (i, _), s in zip(rows, sets)), key=str)


@pytest.mark.parametrize("size,similarity", [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (2, Fraction(1, 2))])
def test_components_are_those_of_all_pairs(awkward, size, similarity):
    rows, docs = awkward
    got = joining.jaccard_join(docs, size, similarity)
    assert sorted((tuple(r) for r in got.collect()), key=str) == linked(rows, size, similarity)


def test_a_large_file_is_searched_in_blocks(spark, monkeypatch):
    """Many documents around the threshold from one another: files are mixed, and blocks of 8 rows meet each other."""
    monkeypatch.setattr(joining, "TREE_ROWS", 8)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(60), rng.randrange(1, 5)):
            words[at] = f"v{rng.randrange(6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for similarity in (Fraction(9, 10), Fraction(4, 5), Fraction(3, 4)):
        got = joining.jaccard_join(docs, 1, similarity)
        assert sorted((tuple(r) for r in got.collect()), key=str) == linked(rows, 1, similarity)


def test_tree_finds_every_pair_its_bound_allows():
    import numpy as np

    rng = np.random.default_rng(1)
    points = rng.poisson(2.0, (300, joining.GROUPS))
    points[150:] = np.maximum(0, points[:150] + rng.integers(-1, 2, (150, joining.GROUPS)) * (rng.random((150, joining.GROUPS)) < 0.1))
    sizes = points.sum(1)
    similarity = Fraction(4, 5)
    got = {tuple(sorted(p)) for a, b in joining.Tree(points, sizes, np.arange(300)).pairs(similarity, chunk=64) for p in zip(a.tolist(), b.tolist())}
    want = set()
    for a in range(300):
        for b in range(a):
            if np.minimum(points[a], points[b]).sum() * 9 >= 4 * (sizes[a] + sizes[b]):
                want.add((b, a))
    assert got == want and len(want) > 50


# ---------------------------------------------------------------- substring dedup


def without_repeats(rows, window):
    first = {}
    for i, text in rows:
        words = spaced(text)
        for p in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        words = spaced(text)
        gone = [False] * len(words)
        for p in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [50, 64, 33, 5])
def test_removed_words_are_those_of_repeated_windows(awkward, window):
    rows, docs = awkward
    got = substring_dedup(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == without_repeats(rows, window)


def test_lengths_double():
    assert lengths(50) == [25, 50] and lengths(64) == [16, 32, 64] and lengths(33) == [33]


def test_texts_without_removed_words(awkward):
    rows, docs = awkward
    results = substring_dedup(docs, 50)
    kept = removed_from(docs, results)
    assert kept.columns == docs.columns
    texts = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    digest = {}
    for r in results.collect():
        digest.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept_sha256"]))
    want = Counter()
    for i, text in rows:
        words = spaced(text)
        own = hashlib.sha256(" ".join(words).encode()).hexdigest()
        if (len(words), 0, own) in digest[i]:
            want[i, text] += 1
    assert all(texts[key] == n for key, n in want.items())
    for i, text in texts - want:
        assert any(sha == hashlib.sha256(text.encode()).hexdigest() and gone for _, gone, sha in digest[i])
    assert not any(i in (300, 301) for i, _ in texts)


# ---------------------------------------------------------------- decontamination


def contaminated(rows, items, n):
    windows = {}
    for i, text in items:
        words = alnum(text)
        size = min(n, len(words))
        for p in range(len(words) - size + 1) if size else ():
            windows.setdefault(tuple(words[p : p + size]), set()).add("" if i is None else str(i))
    out = []
    for i, text in rows:
        words = alnum(text)
        hit, own = [False] * len(words), set()
        for size in {len(w) for w in windows}:
            for p in range(len(words) - size + 1):
                if found := windows.get(tuple(words[p : p + size])):
                    hit[p : p + size] = [True] * size
                    own |= found
        out.append((i, len(words), sum(hit), tuple(sorted(own)), sum(hit) > 0 and 20 * sum(hit) >= len(words)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [250_000, 7])
def test_hit_words_are_those_of_item_windows(spark, awkward, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", block)
    rows, docs = awkward
    texts = dict(rows)
    items = [
        (1, texts[100]), (2, "ONE"), (3, None), (4, ""), (5, texts[300][5000:5200]), (5, "Two  WORDS"), (None, texts[105]),
        (10, texts[200][150:400]), (10, texts[200][150:400]), (7, "never seen anywhere"), (8, "?!"),
    ]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, item string")
    got = decontamination.decontaminate(docs, table, n=13)
    found = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got.collect()]
    assert sorted(found, key=str) == contaminated(rows, items, 13)
    for r in got.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_an_empty_benchmark_hits_nothing(spark, awkward):
    rows, docs = awkward
    empty = spark.createDataFrame([], "item_id bigint, text string")
    got = decontamination.decontaminate(docs, empty)
    assert {(r["n_hit"], len(r["items"]), r["contaminated"]) for r in got.collect()} == {(0, 0, False)}


def test_a_row_proposes_on_one_side_only():
    np = joining.np
    n, most = 60, 4
    a, b = np.triu_indices(n, 1)
    score = 1 - (b - a) / (2 * n)
    (left, right, _), more = joining._best([(a, b, score)], most, np.arange(n))
    assert len(left) <= most * n - most * (most + 1) // 2 and more
    assert {(int(i), int(j)) for i, j in zip(left, right)} == {(j - k, j) for j in range(n) for k in range(1, most + 1) if k <= j}
    assert not joining._best([(a, b, score)], n, np.arange(n))[1]


# ---------------------------------------------------------------- LM scoring


@pytest.mark.parametrize("limit", [160 << 20, 6_000])
def test_scores_follow_the_counts(awkward, monkeypatch, limit):
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", limit)
    rows, docs = awkward
    got = scoring.lm_score(docs, F.col("doc_id") % 3 == 0).collect()
    tokens = [[*spaced(lower(t)), 0] for _, t in rows]
    held = [i is not None and i % 3 == 0 for i, _ in rows]
    single, pairs = Counter(), Counter()
    for own, out in zip(tokens, held):
        if not out:
            single.update(own)
            pairs.update(zip([1, *own[:-1]], own))
    n, v = sum(single.values()), len(single)
    history = single + Counter({1: held.count(False)})
    base = sorted(
        (str(i), out, len(own), sum(single[w] > 0 for w in own), n, round(sum(math.log10((single[w] + 1) / (n + v + 1)) for w in own), 6))
        for (i, _), own, out in zip(rows, tokens, held)
    )
    assert sorted((str(r[0]), *r[1:5], round(r["base_score"], 6)) for r in got) == base

    def level(count):
        return float(scoring.estimated(scoring.quantised(scoring.np.array([count])).astype(float))[0]) if count else 0.0

    def score(own):
        total = 0.0
        for h, w in zip([1, *own[:-1]], own):
            alone = (level(single[w]) + 1) / (n + v + 1)
            both = min(level(pairs[h, w]), level(history[h]))
            total += math.log10((both + scoring.SMOOTHING * alone) / (level(history[h]) + scoring.SMOOTHING))
        return total

    want = sorted(((str(i), score(own)) for (i, _), own in zip(rows, tokens)))
    found = sorted((str(r["doc_id"]), r["score"]) for r in got)
    # The filter can only read counts too high, and rarely does.
    near = sum(abs(a[1] - b[1]) <= 0.02 * abs(a[1]) + 1e-9 for a, b in zip(want, found))
    assert near >= 0.9 * len(want)


def test_counts_leave_a_task_in_small_batches(monkeypatch):
    monkeypatch.setattr(scoring, "BATCH_BYTES", 4000, raising=False)
    texts = scoring.pa.array([f"{i} {i + 1} {i % 7}" for i in range(3000)])
    out = list(scoring._count(6)(iter([scoring.pa.RecordBatch.from_arrays([texts], ["text"])])))
    held = [sum(len(x) for name in ("hashes", "counts") for x in b.column(name).to_pylist()) for b in out]
    assert len(out) > 10 and max(held) < 8000
    assert sum(sum(b.column("tokens").to_pylist()) for b in out) == 4 * 3000
    counted = sum(int(scoring.np.frombuffer(x, "int64").sum()) for b in out for x in b.column("counts").to_pylist())
    assert counted == (4 + 4 + 1) * 3000


def test_without_training_rows_nothing_is_known(awkward):
    rows, docs = awkward
    got = scoring.lm_score(docs, F.lit(True)).collect()
    assert len(got) == len(rows) and {(r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(0, 0, 0.0)}


def test_empty_tables(spark, awkward):
    _, docs = awkward
    none = docs.limit(0)
    assert joining.jaccard_join(none).count() == 0
    assert substring_dedup(none).count() == 0
    assert scoring.lm_score(none, F.lit(False)).count() == 0
    assert decontamination.decontaminate(none, spark.createDataFrame([(1, "a")], "item_id int, text string")).count() == 0


def _written(monkeypatch):
    """Counts of the tables that the join writes."""
    counts, kept = Counter(), joining.cut

    def cut(df, name):
        table = kept(df, name)
        counts[name] += table.count()
        return table

    monkeypatch.setattr(joining, "cut", cut)
    return counts


@pytest.mark.parametrize("n", [50, 200])
def test_alike_but_not_similar_documents_are_hardly_compared(spark, monkeypatch, n):
    """Documents that share most of their words, no two similar: few pairs reach the verification."""
    rng = random.Random(1)
    shared = [f"s{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = list(shared)
        for at in rng.sample(range(300), 18):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    counts = _written(monkeypatch)
    got = joining.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, Fraction(4, 5)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == linked(rows, 5, Fraction(4, 5))
    assert counts["pairs"] <= 10 * n


def test_near_copies_cost_a_few_pairs_each(spark, monkeypatch):
    """Copies of copies: a chain of small changes whose ends are far apart is one component."""
    rng = random.Random(2)
    words, rows = [f"w{i}" for i in range(200)], []
    for i in range(150):
        words = list(words)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((rng.randrange(10**6) * 1000 + i, " ".join(words)))
    counts = _written(monkeypatch)
    got = joining.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, Fraction(4, 5)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == linked(rows, 5, Fraction(4, 5))
    assert len({r.component_id for r in got}) == 1 and counts["pairs"] <= 20 * len(rows)


def test_trees_that_left_none_out_are_searched_once(spark, monkeypatch, tmp_path):
    """Documents too many to verify at once come back; pairs that share files but are not similar do not."""
    kept, folder = joining._tree_join, str(tmp_path)

    def noting(similarity, most):
        run = kept(similarity, most)

        def noted(group):
            with open(f"{folder}/{most}", "a") as out:
                out.write("".join(f"{node}\n" for node in group.column("node").to_pylist()))
            return run(group)

        return noted

    def changed(words, at):
        return " ".join("x" + word if i in at else word for i, word in enumerate(words))

    # Just below the similarity: the bounds let every pair pass, the verification none.
    many = [f"m{i}" for i in range(3000)]
    rows = [(i, changed(many, {6 * (12 * k + i) for k in range(36)}).replace("x", f"x{i}")) for i in range(12)]
    for i in range(20):
        pair = [f"p{i}_{k}" for k in range(300)]
        rows += [(100 + 2 * i, " ".join(pair)), (101 + 2 * i, changed(pair, set(range(0, 300, 20))))]
    monkeypatch.setattr(joining, "_tree_join", noting)
    got = joining.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, Fraction(4, 5)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == linked(rows, 5, Fraction(4, 5))
    searched = {int(f.name): set(map(int, f.read_text().split())) for f in tmp_path.iterdir()}
    assert len(searched) > 1 and any(node >= 100 for node in searched.pop(joining.MET))
    assert {node for nodes in searched.values() for node in nodes} <= set(range(12))


def test_all_links_between_different_texts(awkward):
    """Every similar pair of different texts, each text by its smallest id, and which rows have that text."""
    rows, docs = awkward
    pairs, members = joining.similar_pairs(docs, 3, Fraction(1, 2))
    sets, least = {}, {}
    for i, text in rows:
        words = spaced(lower(text))
        runs = {tuple(words[n : n + 3]) for n in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} if words else set()
        if i is not None and runs:
            key = frozenset(runs)
            least[key] = min(i, least.get(key, i))
            sets[i] = [*sets.get(i, []), key]
    want = {tuple(sorted((least[x], least[y]))) for x in least for y in least
            if least[x] < least[y] and Fraction(len(x & y), len(x | y)) >= Fraction(1, 2)}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    assert {(r.doc_id, r.node) for r in members.collect()} == {(i, least[key]) for i, keys in sets.items() for key in keys}
