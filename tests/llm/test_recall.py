"""What the quality classifier finds, against truth that it is not told."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality
from ledgerloom.llm.words import ALNUM, words

LARGER, LARGEST = "/root/testdata/sf0.1", "/root/testdata/check_s"


def known(text, items):
    return any(np.isin(mark, items[0]).any() for _, mark in quality._marks(words(pa.array([text]), ALNUM)))


def test_words_of_a_rare_language_and_of_a_clean_document_stay(spark):
    rows = [(i, f"vile number{i}", 1) for i in range(2400)] + [(i, f"nice number{i}", 0) for i in range(2400, 9000)]
    rows += [(9000 + i, f"olcso szam{i}", 1) for i in range(9)]
    rows += [(9100 + i, f"mixed thing{i}", int(i > 0)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    found = quality.toxic_marks(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert all(known(word, found) for word in ("vile", "olcso", "mixed")) and not known("nice", found)


def held_out_shares(spark, folder):
    """The share of held-out labelled documents with words that are found toxic, by language and truth."""
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    judged = quality.classify(docs, labels.where(half == 0)).join(labels.where((half == 1) & (F.col("quality") == 1)), "doc_id")
    judged = judged.join(docs.select("doc_id", "lang"), "doc_id").where("n_words > 0")
    found = judged.groupBy("lang", "toxic").agg(F.avg((F.col("toxic_score") > 0).cast("int")).alias("share"))
    return {(r["lang"], r["toxic"]): r["share"] for r in found.collect()}


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no data folder")
def test_held_out_toxic_recall_by_language(spark):
    """About nine toxic Spanish texts are left to learn from here, whose marks clean texts have too: see the README."""
    found = held_out_shares(spark, LARGER)
    assert min(found[lang, 1] for lang in ("en", "de", "fr")) >= 0.9
    assert max(found[lang, 0] for lang in ("en", "de", "fr", "es")) < 0.02


@pytest.mark.skipif(not os.path.isdir(LARGEST), reason="no data folder")
def test_held_out_toxic_recall_with_more_labels(spark):
    found = held_out_shares(spark, LARGEST)
    assert min(found[lang, 1] for lang in ("en", "de", "fr", "es")) >= 0.9
    assert max(found[lang, 0] for lang in ("en", "de", "fr", "es")) < 0.01


def _runs_of(rng, first, last, runs, longest):
    return " ".join("".join(chr(rng.randrange(first, last)) for _ in range(rng.randrange(4, longest))) for _ in range(runs))


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no data folder")
def test_no_script_is_junk(spark):
    """Scripts without spaces between words, and scripts beyond ASCII with them, next to the given documents."""
    rng = random.Random(8)
    scripts = {"chinese": (0x4E00, 0x9FA0, 24), "thai": (0x0E01, 0x0E2F, 40), "cyrillic": (0x0430, 0x0450, 9),
               "greek": (0x03B1, 0x03CA, 10), "arabic": (0x0627, 0x063B, 8), "hangul": (0xAC00, 0xD7A0, 6)}
    rows = []
    for at, (first, last, longest) in enumerate(scripts.values()):
        rows += [(10**9 + at * 1000 + i, _runs_of(rng, first, last, rng.randrange(20, 60), longest)) for i in range(100)]
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    judged = quality.classify(docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string")), labels)
    kept = judged.where("doc_id >= 1000000000 and keep").groupBy(F.expr("int((doc_id - 1000000000) div 1000)")).count()
    kept = dict(tuple(row) for row in kept.collect())
    assert {name: kept.get(at, 0) for at, name in enumerate(scripts)} == dict.fromkeys(scripts, 100)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no data folder")
def test_junk_recall_by_kind(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{name}.parquet") for name in ("documents", "labels"))
    text = F.col("text")
    kind = (
        F.when(F.size(F.split(text, "!!")) > 6, "capitals")
        .when(F.size(F.split(text, r" \| ")) > 6, "bars")
        .when(text.rlike(r"(###|%%%|\$\$\$|&&&|\*\*\*)"), "signs")
        .when(text.rlike(r"(?s)\b(\S+) \1 \1 \1 \1 "), "repeats")
        .otherwise("other")
    )
    judged = quality.classify(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", kind.alias("kind")), "doc_id")
    found = judged.where("n_words > 0").groupBy("quality", "kind").agg(F.avg((F.col("junk_score") > 0).cast("int")).alias("share"))
    found = {(r["quality"], r["kind"]): r["share"] for r in found.collect()}
    assert all(found[0, name] > 0.97 for name in ("capitals", "bars", "signs", "repeats"))
    assert found[1, "other"] < 0.02


def test_a_yes_vote_is_never_evidence_for_no():
    counts = {"111111111": 8500, "210111001": 400, "212111021": 300, "111222111": 150, "111122110": 50, "000000000": 100}
    found = quality.of_any_kind(counts, quality.KINDS)
    assert found["111111111"] < 0.1 and min(found[name] for name in ("212111021", "111222111", "111122110")) > 0.5


def test_marks_that_chance_explains_do_not_count():
    """Of many marks without meaning hardly any passes, however many there are."""
    rng = np.random.default_rng(3)
    held = rng.integers(quality.LEAST_HELD, 40, 200_000)
    bad = rng.binomial(held, 0.1)
    rate = np.clip(bad / held, 1e-9, 1 - 1e-9)
    surprise = np.where(bad > 0.1 * held, held * (rate * np.log(rate / 0.1) + (1 - rate) * np.log((1 - rate) / 0.9)), 0)
    steps = dict(zip(*(x.tolist() for x in np.unique((surprise * 4).astype(int), return_counts=True))))
    assert (surprise >= quality._least_surprise(steps)).sum() <= 2
    steps[200] = 500
    assert quality._least_surprise(steps) <= 50 and (surprise >= quality._least_surprise(steps)).sum() <= 10
