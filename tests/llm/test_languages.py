"""Languages with few documents, and declarations far inside a tag."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language_id as module

LARGER = "/root/testdata/sf0.1"

STEMS = {"en": ["the", "th", "ing", "wh"], "de": ["sch", "ung", "der", "keit"], "hu": ["sz", "gy", "nek", "ös"]}


@pytest.mark.parametrize("block", [512, 1])
def test_a_rare_language_is_learnt(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_LANGUAGES", block)
    rng = random.Random(8)

    def prose(lang, n=60):
        return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    texts = [(prose(lang), lang) for lang, n in (("en", 700), ("de", 300), ("hu", 3)) for _ in range(n)]
    docs = spark.createDataFrame(texts, "text string, lang string")
    rows = [(i, f"http://h{i % 7}.{lang}/", f'<html lang="{lang}"><p>{prose(lang)}</p></html>', lang)
            for i, lang in enumerate(["en"] * 60 + ["de"] * 30 + ["hu"] * 6)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, truth string").repartition(2)
    got = {r["page_id"]: (r["lang"], r["text_lang"], r["declared"]) for r in module.language_id(pages, docs).collect()}
    assert got == {i: (lang, lang, lang) for i, _, _, lang in rows}


def test_a_declaration_is_found_anywhere_in_its_tag():
    assert module.declared_language(b"<html " + b'data-x="y" ' * 1000 + b'lang="hu">') == "hu"
    assert module.declared_language(b"<html><body lang=de><HTML LANG = 'EN-us'>") == "en"
    assert module.declared_language(b"<html lang=abcd>") is None and module.declared_language(b"<html" * 100_000) is None


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no data folder")
def test_languages_of_the_given_pages(spark):
    """Pages name their language in a folder of their address, which the operator doesn't read; by text alone it is found too."""
    pages, docs = (spark.read.parquet(f"{LARGER}/{name}.parquet") for name in ("pages", "documents"))
    truth = pages.select("page_id", F.regexp_extract("url", "://[^/]*/([a-z]{2})/", 1).alias("truth")).where("truth <> ''")
    found = module.language_id(pages, docs).join(truth, "page_id").where("truth in ('en', 'de', 'fr', 'es')")
    shares = found.groupBy("truth").agg(
        F.count("*").alias("pages"),
        F.avg((F.col("lang") == F.col("truth")).cast("int")).alias("fused"),
        F.avg((F.col("text_lang") == F.col("truth")).cast("int")).alias("text"),
    )
    for row in shares.collect():
        assert row.pages > 100 and row.fused >= 0.95 and row.text >= 0.9, row
