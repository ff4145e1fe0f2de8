"""Quality classifier: weak labels, an EM model of their accuracies, and a hashed linear scorer trained on its posteriors.

Two questions are asked of every document, whether it is junk and whether it is toxic, each by several overlapping
labellers that vote yes (2), no (1) or abstain (0). Junk labellers look at style, three at each kind of junk. Toxicity
labellers look for marks that the labelled documents show to be toxic: one for whole words, one for beginnings of words,
one for pieces inside words, so that inflected and compound forms are known too. What the marks are is counted on a bounded
sample of labels (``LABELLED`` rows), as they differ from corpus to corpus.

The votes of all documents are counted by pattern, of which there are few (3 to the number of labellers), and EM runs on
the counts, for toxicity and for each kind of junk by itself: it estimates how often each labeller votes what for either
class, without any true label. The posteriors of the patterns are then the targets of a logistic regression over hashed
features (style in steps, and the toxic marks a document holds), fitted on at most ``FITTED`` documents, chosen by hash. Its
scores decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.rows import keyed
from ledgerloom.llm.words import ALNUM, SPACED, Words, grams, hashed, mix, slices, words
from ledgerloom.session import cut

#: Text bytes handled at once.
SLICE = 1 << 20
#: The most labelled documents that items are counted on, and documents that the scorer is fitted on, by least hash.
LABELLED = 50_000
FITTED = 20_000
#: The share of false ones among the marks that are taken for toxic.
FALSE_SHARE = 0.01
#: A mark counts where its documents are so many times as likely toxic as not.
LIKELY = 2.0
#: Labelled texts that share the least run of so many words, by any of so many hashes, are taken for near copies.
RUN, KEYS = 5, 3
#: Marks in fewer labelled texts are not looked at: they can hardly show anything.
LEAST_HELD = 4
#: Bytes of the beginnings of longer words, and of the pieces inside words, that are counted besides whole words.
STEMS = (8, 6, 5, 4)
PIECE = 5
#: A labeller votes toxic where its marks make that so many times as likely as not.
SURE = 40.0
#: Features are hashed to so many weights.
WEIGHTS = 1 << 16
#: Labellers of toxicity: whole words, beginnings of words, pieces inside words.
MARKS = 3

STYLES = ("symbols", "capitals", "letters", "repeats", "distinct", "commonest", "word_length", "short_words", "lumps")
#: Kinds of junk, by the places of the styles that know it: odd signs, repetition, odd words.
KINDS = ((0, 1, 2), (3, 4, 5), (6, 7, 8))
#: For each style: below the first bound or above the last it votes junk, between the inner two it votes against.
BOUNDS = {
    "symbols": (-1.0, -1.0, 0.002, 0.02),
    "capitals": (-1.0, -1.0, 0.08, 0.2),
    "repeats": (-1.0, -1.0, 0.02, 0.1),
    "distinct": (0.25, 0.5, 2.0, 2.0),
    "commonest": (-1.0, -1.0, 0.2, 0.4),
    "letters": (0.6, 0.76, 0.86, 2.0),
    "word_length": (3.0, 4.5, 7.5, 15.0),
    "short_words": (0.02, 0.15, 0.45, 2.0),
    "lumps": (-1.0, -1.0, 0.02, 0.3),
}
#: Words longer than this, in characters, are lumps.
LUMP = 30
#: Where words have more characters on average and are mostly written beyond ASCII, spaces do not part words.
UNPARTED = 9.0
#: Texts of fewer words are too short for any style but symbols.
FEW_WORDS = 12
#: Distinct words are set against so many at most.
MANY_WORDS = 400

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x80:0xC0] = True
_BEYOND = np.zeros(256, bool)
_BEYOND[0x80:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*+/<=>@\\^_`{|}~!")] = True


def styles(found: Words) -> np.ndarray:
    """The style numbers of every text (rows) in the order of ``STYLES``; not a number where a style has nothing to say.

    Lengths are in characters. Where spaces do not part words, as in scripts written without them, words say nothing.
    """
    n = len(found.first) - 1
    size = np.maximum(1, np.diff(found.offsets))
    count, texts = np.maximum(1, found.counts), found.text_of

    def share(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks[found.data])])
        return (total[found.offsets[1:]] - total[found.offsets[:-1]]) / size

    inner = texts[1:] == texts[:-1]
    same = (found.hashes[1:] == found.hashes[:-1]) & inner
    follows = np.concatenate([[0], np.cumsum(_FOLLOWS[found.data])])
    length = found.ends - found.starts - (follows[found.ends] - follows[found.starts])

    order = np.lexsort((found.hashes, texts))
    begins = np.ones(len(order), bool)
    begins[1:] = (found.hashes[order][1:] != found.hashes[order][:-1]) | ~inner
    often = np.diff(np.append(np.flatnonzero(begins), len(order)))
    commonest = np.zeros(n)
    np.maximum.at(commonest, texts[order][begins], often)

    per_text = lambda x: np.bincount(texts, weights=x, minlength=n) / count
    mean = per_text(length.astype(float))
    unparted = (mean > UNPARTED) & (share(_BEYOND) > 0.5)
    of_words = np.stack([mean, per_text((length <= 3).astype(float)), per_text((length > LUMP) * length) / np.maximum(1, mean)])
    return np.concatenate(
        [
            np.stack(
                [
                    share(_SYMBOL),
                    share(_CAPITAL),
                    share(_LETTER),
                    np.bincount(texts[1:][same], minlength=n) / count,
                    # Long texts repeat words as a matter of course.
                    np.bincount(texts, weights=begins, minlength=n) / np.minimum(count, MANY_WORDS),
                    commonest / count,
                ]
            ),
            np.where(unparted, np.nan, of_words),
        ]
    ).T


def style_votes(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    votes = np.zeros(numbers.shape, np.int64)
    for i, name in enumerate(STYLES):
        low, from_, to, high = BOUNDS[name]
        x = numbers[:, i]
        votes[:, i] = np.where((x < low) | (x > high), 2, np.where((x >= from_) & (x <= to), 1, 0))
        votes[np.isnan(x), i] = 0
        if name != "symbols":
            votes[counts < FEW_WORDS, i] = 0
    return votes


def _distinct(value: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every value of a text once."""
    order = np.lexsort((value, texts))
    value, texts = value[order], texts[order]
    new = np.ones(len(order), bool)
    new[1:] = (value[1:] != value[:-1]) | (texts[1:] != texts[:-1])
    return value[new], texts[new]


def _marks(found: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For whole words, each length of beginnings and inner pieces: the word of each, and its hash, which tells them apart."""
    length = found.ends - found.starts
    marks = [(np.arange(len(found.hashes)), mix(found.hashes + np.uint64(1)))]
    for size in STEMS:
        long = np.flatnonzero(length > size)
        starts = found.starts[long]
        marks.append((long, mix(hashed(found.data, starts, starts + size) + np.uint64(256 + size))))
    inner = np.maximum(0, length - PIECE)
    word = np.repeat(np.arange(len(inner)), inner)
    starts = found.starts[word] + 1 + np.arange(len(word)) - np.repeat(inner.cumsum() - inner, inner)
    marks.append((word, mix(hashed(found.data, starts, starts + PIECE) + np.uint64(512))))
    return marks


def _sums(value: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every value, ascending, how often it is there, and how often with ``bad``."""
    order = np.argsort(value, kind="stable")
    value, bad = value[order], bad[order].astype(np.int64)
    starts = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
    return value[starts], np.diff(np.append(starts, len(value))), np.add.reduceat(bad, starts) if len(starts) else bad


def _mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of labelled texts: the texts of a slice, and the different words in them, that hold a mark, and the toxic ones."""
    for rows in slices(batches, "text", SLICE):
        toxic = rows.column("toxic").to_numpy()
        found = words(rows.column("text"), ALNUM, fold=True)
        # The first of equal words of a text stands for all.
        order = np.lexsort((found.hashes, found.text_of))
        new = np.ones(len(order), bool)
        new[1:] = (found.hashes[order][1:] != found.hashes[order][:-1]) | (found.text_of[1:] != found.text_of[:-1])
        once = np.zeros(len(order), bool)
        once[order[new]] = True
        for kind, (place, value) in zip((0, *[1] * len(STEMS), 2), _marks(found)):
            place, value = place[once[place]], value[once[place]]
            mark, uses, bad_uses = _sums(*_distinct_uses(value, place, toxic[found.text_of]))
            value, texts = _distinct(value, found.text_of[place])
            _, held, bad = _sums(value, toxic[texts])
            columns = [np.full(len(mark), kind, np.int32), mark.view(np.int64), held, bad, uses, bad_uses]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["kind", "mark", "held", "toxic", "uses", "toxic_uses"])


def _distinct_uses(value: np.ndarray, place: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every mark of a word once, and whether the word is in a toxic text."""
    value, place = _distinct(value, place)
    return value, bad[place]


def _least_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the least hash of their runs of ``RUN`` words, by ``KEYS`` hashes."""
    for rows in slices(batches, "text", SLICE):
        found = words(rows.column("text"), SPACED, fold=True)
        runs, first, counts = grams(found.hashes, RUN), found.first, found.counts
        keys = np.zeros((KEYS, rows.num_rows), np.uint64)
        for i, n in enumerate(counts.tolist()):
            own = runs[first[i] : first[i + 1] - RUN + 1] if n >= RUN else grams(found.hashes[first[i] : first[i + 1]], n)
            for key in range(KEYS if n else 0):
                keys[key, i] = mix(own + np.uint64(key << 40)).min()
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * KEYS), pa.array(keys.T.ravel().view(np.int64))
        )
        yield pa.RecordBatch.from_arrays([rows.column("text"), rows.column("toxic"), lists], ["text", "toxic", "keys"])


def _without_copies(texts: DataFrame) -> DataFrame:
    """Texts without near copies of others of their label, which would count chance words often.

    A near copy shares most of its runs of words, and so the least of them by some hash: of texts that share one, one stays.
    """
    keyed_texts = texts.mapInArrow(_least_runs, "text string, toxic int, keys array<bigint>")
    named = cut(keyed_texts.withColumn("own", F.xxhash64("text")), "labelled_texts")
    each = named.select("toxic", "own", F.posexplode("keys").alias("place", "key"))
    least = each.groupBy("toxic", "place", "key").agg(F.min("own").alias("least"))
    later = each.join(least, ["toxic", "place", "key"]).where("own > least").select("own", "toxic").distinct()
    return cut(named.join(later, ["own", "toxic"], "left_anti").select("text", "toxic"), "labelled_texts")


def toxic_marks(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes of the marks of labelled documents that go with toxicity, sorted, their weights, and the weight of none.

    The weight of a mark is the smoothed log odds of the texts of the different words that hold it against those of all: a
    clean document lowers it and does not drop it, and a text with many words of a toxic beginning counts more than one with
    a single word. A mark counts if such words are ``LIKELY`` times as likely in toxic texts as not, and if chance would put
    it into toxic documents so often only seldom (the Chernoff bound for its own number of documents, so neither a rare language nor
    many labels raise the bar). How seldom follows from the number of marks of its kind that were looked at: of those that
    count at most ``FALSE_SHARE`` are there by chance (Benjamini and Hochberg). That bounds their number: a mark lies in
    ``LEAST_HELD`` labelled texts at least.
    """
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = cut(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "labelled")
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        F.broadcast(chosen.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int"))), "doc_id"
    )
    known = _without_copies(known.groupBy("text").agg(F.max("toxic").alias("toxic")))
    total, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic or toxic == total:
        return np.empty(0, np.uint64), np.empty(0), 0.0
    share = toxic / total
    base = float(np.log(share / (1 - share)))
    numbers = ["held", "toxic", "uses", "toxic_uses"]
    rows = known.mapInArrow(_mark_rows, "kind int, mark bigint, " + ", ".join(f"{name} bigint" for name in numbers))
    counted = rows.groupBy("kind", "mark").agg(*[F.sum(name).alias(name) for name in numbers])
    bad, good = F.col("toxic"), F.col("held") - F.col("toxic")
    against = F.when(good > 0, good * F.log(good / F.col("held") / (1 - share))).otherwise(0.0)
    surprise = F.when(bad > share * F.col("held"), bad * F.log(bad / F.col("held") / share) + against).otherwise(0.0)
    weight = F.log((F.col("toxic_uses") + share) / (F.col("uses") - F.col("toxic_uses") + 1 - share)) - base
    tested = counted.where(F.col("held") >= LEAST_HELD)
    tested = cut(tested.select("kind", "mark", surprise.alias("surprise"), weight.alias("weight")), "tested_marks")
    steps = tested.groupBy("kind", F.least(F.floor(F.col("surprise") * 4), F.lit(400)).alias("step")).count().collect()
    enough = F.lit(False)
    for kind in range(MARKS):
        least = _least_surprise({row["step"]: row["count"] for row in steps if row["kind"] == kind})
        enough = enough | ((F.col("kind") == kind) & (F.col("surprise") >= least))
    best = tested.where(enough & (F.col("weight") > float(np.log(LIKELY)) - base)).select("mark", "weight").toArrow()
    found = best.column("mark").to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], best.column("weight").to_numpy()[order], base


def _least_surprise(steps: dict[int, int]) -> float:
    """The least surprise (-log of the chance) from which on at most ``FALSE_SHARE`` of the marks are expected by chance.

    ``steps`` counts marks by quarters of surprise.
    """
    all_marks, above = sum(steps.values()), 0
    least = float("inf")
    for step in sorted(steps, reverse=True):
        above += steps[step]
        if all_marks * np.exp(-step / 4) <= FALSE_SHARE * above:
            least = step / 4
    return least


def _hashed(kind: int, value: np.ndarray) -> np.ndarray:
    return (mix(value.astype(np.uint64) + mix(np.uint64([kind + 1]))) & np.uint64(WEIGHTS - 1)).astype(np.int32)


def _known(place: np.ndarray, mark: np.ndarray, wanted: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose mark is wanted, and which one it is; ``marks`` rules out most others at once."""
    maybe = np.flatnonzero(marks[(mark & np.uint64(len(marks) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(wanted, mark[maybe]), len(wanted) - 1)
    same = wanted[at] == mark[maybe]
    return place[maybe[same]], at[same]


def _judged(known):
    """Votes and hashed features of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, base = known.value
        marks = np.zeros(1 << 20, bool)
        marks[(wanted & np.uint64(len(marks) - 1)).astype(np.int64)] = True
        for rows in slices(batches, "text", SLICE):
            n = rows.num_rows
            plain = words(rows.column("text"), SPACED, fold=True)
            numbers = styles(plain)
            junk = style_votes(numbers, plain.counts)
            # Style in steps: doubling ones near 0, which small shares need, and even ones.
            numbers = np.nan_to_num(numbers, nan=-1e-4)
            steps = np.concatenate([np.floor(numbers * 20), np.floor(np.log2(numbers + 2e-4) * 2) + 1000], axis=1)
            features = _hashed(0, steps.astype(np.int64) * 64 + np.arange(steps.shape[1])).reshape(steps.shape)
            junk_features = [np.unique(x) for x in features]
            found = words(rows.column("text"), ALNUM, fold=True)
            toxic = np.zeros((n, MARKS), np.int64)
            texts_of, value, total = np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(n)
            hits = [_known(place, mark, wanted, marks) for place, mark in _marks(found)] if len(wanted) else []
            for kind, group in enumerate((hits[:1], hits[1:-1], hits[-1:]) if hits else ()):
                # Of a word its likeliest mark counts, of a text's equal words one.
                place, item = (np.concatenate(column) for column in zip(*group))
                order = np.argsort(weights[item], kind="stable")
                best = np.full(len(found.hashes), -1)
                best[place[order]] = item[order]
                held = np.flatnonzero(best >= 0)
                order = held[np.lexsort((found.hashes[held], found.text_of[held]))]
                texts, own = found.text_of[order], found.hashes[order]
                new = np.ones(len(order), bool)
                new[1:] = (own[1:] != own[:-1]) | (texts[1:] != texts[:-1])
                item, texts = best[order[new]], texts[new]
                odds = np.bincount(texts, weights=weights[item], minlength=n)
                # Marks that leave it open say nothing.
                toxic[:, kind] = np.where(base + odds > np.log(SURE), 2, np.where((odds == 0) | (base + odds < 0), 1, 0))
                texts_of, value = np.concatenate([texts_of, texts]), np.concatenate([value, wanted[item]])
                total = np.maximum(total, odds)
            # Besides each mark the best odds in steps are a feature, for marks that no fitted document holds.
            held = np.unique(texts_of)
            steps = np.clip(np.floor(base + total[held]), -4, 8) + 4
            texts_of = np.concatenate([texts_of, held])
            hits = np.concatenate([_hashed(1, value), _hashed(2, steps)])
            toxic[plain.counts == 0] = 0
            order = np.argsort(texts_of, kind="stable")
            edges = np.searchsorted(texts_of[order], np.arange(n + 1))
            toxic_features = [np.unique(hits[order[a:b]]) for a, b in zip(edges, edges[1:])]
            text = lambda votes: pa.array(["".join(map(str, row)) for row in votes.tolist()])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("row_hash"),
                    pa.array(plain.counts.astype(np.int64)),
                    text(junk),
                    text(toxic),
                    pa.array(junk_features, pa.list_(pa.int32())),
                    pa.array(toxic_features, pa.list_(pa.int32())),
                ],
                ["doc_id", "row_hash", "n_words", "junk_votes", "toxic_votes", "junk_features", "toxic_features"],
            )

    return run


def posteriors(patterns: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """The probability of yes for every vote pattern, by EM over patterns and their counts.

    Either class has its own share of yes and no for each labeller; an abstention says nothing. No yes vote is evidence
    for no: a labeller that would say yes more often in the class no gets one share for both. The start is the patterns
    themselves: more yes than no votes are a likely yes, as many or fewer a less likely one, none an unlikely one.
    """
    names = sorted(patterns)
    votes = np.array([[int(v) for v in name] for name in names])
    weight = np.array([patterns[name] for name in names], float)
    if votes.size == 0:
        return {name: 0.0 for name in names}
    for_, against = (votes == 2).sum(1), (votes == 1).sum(1)
    yes = np.select([for_ > against, (for_ == against) & (for_ > 0), for_ > 0], [0.9, 0.3, 0.1], 0.02)
    for _ in range(rounds):
        share = np.clip((weight * yes).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        log = np.stack([np.full(len(names), np.log(1 - share)), np.full(len(names), np.log(share))])
        for labeller in range(votes.shape[1]):
            held = [np.bincount(votes[:, labeller], weights=mass, minlength=3)[1:] for mass in (weight * (1 - yes), weight * yes)]
            counts = np.stack(held) + 0.1
            shares = counts / counts.sum(1, keepdims=True)
            if shares[1, 1] < shares[0, 1]:
                shares[:] = counts.sum(0) / counts.sum()
            for which in (0, 1):
                log[which] += np.concatenate([[0], np.log(shares[which])])[votes[:, labeller]]
        after = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(after - yes).max() < 1e-9:
            break
        yes = after
    return dict(zip(names, yes.tolist()))


def of_any_kind(patterns: dict[str, int], kinds: tuple[tuple[int, ...], ...]) -> dict[str, float]:
    """The probability that a vote pattern is of any kind, each kind judged by labellers of its own."""
    none = dict.fromkeys(patterns, 1.0)
    for kind in kinds:
        part = {name: "".join(name[i] for i in kind) for name in patterns}
        counts: dict[str, int] = {}
        for name, own in part.items():
            counts[own] = counts.get(own, 0) + patterns[name]
        found = posteriors(counts)
        none = {name: none[name] * (1 - found[part[name]]) for name in patterns}
    return {name: 1 - p for name, p in none.items()}


def fitted(features: list[np.ndarray], targets: np.ndarray, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sets of hashed features, by gradient steps with momentum."""
    weights, bias = np.zeros(WEIGHTS), 0.0
    if not len(features) or targets.min(initial=1) > 0.5 or targets.max(initial=0) < 0.5:
        return weights, 4.0 if len(features) and targets.min() > 0.5 else -4.0
    sizes = np.array([len(x) for x in features])
    rows, flat = np.repeat(np.arange(len(features)), sizes), np.concatenate([np.empty(0, np.int64), *features]).astype(np.int64)
    used, place = np.unique(flat, return_inverse=True)
    own = np.zeros(len(used))
    # Either class weighs the same; a feature's step is scaled by how often it occurs.
    yes = targets > 0.5
    weight = np.where(yes, 0.5 / max(1, yes.sum()), 0.5 / max(1, (~yes).sum()))
    scale = np.bincount(place, weights=weight[rows], minlength=len(used)) + 1e-4
    speed, bias_speed = np.zeros(len(used)), 0.0
    for _ in range(rounds):
        score = np.bincount(rows, weights=own[place], minlength=len(features)) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - targets) * weight
        slope = np.bincount(place, weights=error[rows], minlength=len(used)) + 1e-5 * own
        speed = 0.9 * speed - 0.1 * slope / scale
        bias_speed = 0.9 * bias_speed - 0.1 * error.sum()
        own, bias = own + speed, bias + bias_speed
    weights[used] = own
    return weights, bias


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            scores = []
            for column, (weights, bias) in zip(("junk_features", "toxic_features"), model.value):
                lists = rows.column(column)
                texts = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten().to_numpy()
                scores.append(np.bincount(texts, weights=weights[flat], minlength=len(lists)) + bias)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("doc_id", "row_hash", "n_words", "junk_votes", "toxic_votes")), *map(pa.array, scores)],
                ["doc_id", "row_hash", "n_words", "junk_votes", "toxic_votes", "junk_score", "toxic_score"],
            )

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, row_hash, n_words, votes, junk_score, toxic_score, keep.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic (0 or 1; of repeated ids the larger). A document is kept if
    it has words and both scores, log odds, are at most 0. Without labels that are both toxic and not, nothing is toxic. A
    NULL or empty text is not kept. Equal texts get equal results whatever their ids, also a NULL one; other columns are
    ignored.
    """
    spark = docs.sparkSession
    texts = keyed(docs.select("doc_id", "text"))
    known = spark.sparkContext.broadcast(toxic_marks(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()
    judged = cut(
        texts.mapInArrow(
            _judged(known),
            f"doc_id {kind}, row_hash bigint, n_words bigint, junk_votes string, toxic_votes string,"
            " junk_features array<int>, toxic_features array<int>",
        ),
        "judged",
    )
    model = []
    sample = judged.where("n_words > 0").orderBy(F.hash("row_hash"), "row_hash", "doc_id").limit(FITTED)
    chosen = sample.select("junk_votes", "junk_features", "toxic_votes", "toxic_features").collect()
    for which in ("junk", "toxic"):
        counts = judged.where("n_words > 0").groupBy(f"{which}_votes").count().collect()
        patterns = {r[0]: r[1] for r in counts}
        likely = of_any_kind(patterns, KINDS) if which == "junk" else posteriors(patterns)
        targets = np.array([likely[r[f"{which}_votes"]] for r in chosen])
        model.append(fitted([np.array(r[f"{which}_features"], np.int64) for r in chosen], targets))
    scored = judged.mapInArrow(
        _scored(spark.sparkContext.broadcast(model)),
        f"doc_id {kind}, row_hash bigint, n_words bigint, junk_votes string, toxic_votes string,"
        " junk_score double, toxic_score double",
    )
    return scored.withColumn("keep", F.expr("n_words > 0 and junk_score <= 0 and toxic_score <= 0"))
