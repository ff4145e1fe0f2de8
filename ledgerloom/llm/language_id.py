"""Language of pages by Bayesian evidence fusion.

For every page and language four kinds of evidence are added up as logarithms:

* the text's likelihood under a byte trigram model, learnt from documents of known language and tempered, as trigrams are
  not independent;
* how likely the declared language (the ``lang`` of the html element) is for pages of that language;
* how likely the suffix of the address is;
* the prior of the host: its own pages, smoothed towards its domain's, and those towards all pages'.

The last three come from grouped aggregation of the pages' text-only posteriors, without labels; a page's own part in its
host's and domain's counts is taken out again. Group tables are joined back on their keys, so a host with a third of all
pages is a skewed join key with one row on the other side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import flat, slices
from ledgerloom.session import cut

#: Trigrams are hashed to so many counts.
TRIGRAMS = 1 << 14
#: Languages whose tables are broadcast at once (128 KB each); more take several passes over the pages.
BLOCK_LANGUAGES = 512
#: Weight of a trigram as evidence.
TEMPER = 0.1
#: Pages' worth of the wider group in the prior of a narrower one.
SMOOTHING = 10.0

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 0x20
for _range in (range(0x41), range(0x5B, 0x61), range(0x7B, 0x80)):
    _FOLD[list(_range)] = 0x20

_RAW = re.compile(rb"<(/?)(script|style)\b", re.I)
_HTML = re.compile(rb"<html\b", re.I)
_LANG = re.compile(rb"\slang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of texts that hold a letter, and their text numbers; digits and signs count as spaces."""
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    folded = _FOLD[data]
    value = folded[:-2] | folded[1:-1] << np.uint32(8) | folded[2:] << np.uint32(16)
    inside = np.ones(len(value), bool)
    for edge in offsets[1:-1].tolist():
        inside[max(0, edge - 2) : edge] = False
    # Runs of spaces say nothing.
    inside &= (folded[1:-1] != 0x20) | ((folded[:-2] != 0x20) & (folded[2:] != 0x20))
    at = np.flatnonzero(inside)
    hashed = (value[at] * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAMS.bit_length() + 1)
    return hashed.astype(np.int64), np.searchsorted(offsets, at, "right") - 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language, added up over a partition."""
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                ["lang", "trigram", "n"],
            )
        held.clear()

    for rows in slices(batches, "text"):
        data, offsets = flat(rows.column("text"))
        trigrams, texts = _trigrams(data, offsets)
        names = np.array(rows.column("lang").to_pylist(), object)
        for lang in sorted(set(names)):
            own = trigrams[(names == lang)[texts]]
            held[lang] = held.get(lang, 0) + np.bincount(own, minlength=TRIGRAMS).astype(np.int64)
        if len(held) > 256:
            yield from flush()
    yield from flush()


def plain_text(html: bytes) -> bytes:
    """A page without tags, scripts and styles, each of which becomes a space; an unclosed one reaches to the end."""
    data = np.frombuffer(html, np.uint8)
    if not len(data):
        return b""
    place = np.arange(len(data))
    opened = np.maximum.accumulate(np.where(data == 0x3C, place, -1))
    closed = np.maximum.accumulate(np.where(data == 0x3E, place, -1))
    hidden = (opened > closed) | (data == 0x3E) & (np.concatenate([[-1], opened[:-1]]) > np.concatenate([[-1], closed[:-1]]))
    start, kind = -1, b""
    for mark in _RAW.finditer(html):
        if start < 0 and not mark[1]:
            start, kind = mark.start(), mark[2].lower()
        elif start >= 0 and mark[1] and mark[2].lower() == kind:
            hidden[start : mark.start()] = True
            start = -1
    if start >= 0:
        hidden[start:] = True
    return np.where(hidden, np.uint8(0x20), data).tobytes()


def declared_language(html: bytes) -> str | None:
    """The lang attribute of the first html element that has one, in lower case; an unclosed tag reaches to the end."""
    end = 0
    for tag in _HTML.finditer(html):
        if tag.start() < end:
            continue
        end = html.find(b">", tag.end())
        end = len(html) if end < 0 else end
        if mark := _LANG.search(html, tag.end(), end):
            return mark[1].decode().lower()
    return None


def _evidence(model, first: bool, last: bool):
    """Likelihoods under a block of languages, put behind those of the blocks before; the page goes on to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for rows in slices(batches, "html"):
            pages = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in rows.column("html").cast(pa.large_binary())]
            data, offsets = flat(pa.array([plain_text(page) for page in pages], pa.large_binary()))
            trigrams, texts = _trigrams(data, offsets)
            likely = np.stack([np.bincount(texts, weights=row[trigrams], minlength=len(pages)) for row in table], axis=1)
            if first:
                declared = pa.array([declared_language(page) for page in pages], pa.string())
            else:
                declared = rows.column("declared")
                found = rows.column("likely").flatten().to_numpy().reshape(len(pages), -1)
                likely = np.concatenate([found, likely], axis=1)
            out = {"page_id": rows.column("page_id"), "host": rows.column("host"), "declared": declared}
            out |= {"likely": pa.array(list(likely), pa.list_(pa.float64()))} | ({} if last else {"html": rows.column("html")})
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def _softmax(logs: Column) -> Column:
    """Probabilities from an array of logarithms."""
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _group_counts(posterior: DataFrame, key: str, languages: int, name: str) -> DataFrame:
    """Expected pages of each language for every value of ``key``."""
    sums = [F.sum(F.col("posterior")[i]) for i in range(languages)]
    return posterior.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*sums).alias(name))


def language_id(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per page row: page_id, lang, confidence, text_lang, declared, host.

    ``pages`` has page_id, url and html; ``documents`` text and lang, NULL languages ignored. ``lang`` has the largest
    posterior (of equals, the first by name), ``confidence`` is that, ``text_lang`` the best by text alone. A NULL or empty
    page is judged by the other evidence, a NULL url has no host and suffix; missing evidence counts as none. Without
    training documents the languages are NULL; every language that has a document is learnt. Repeated rows count each;
    other columns are ignored.
    """
    spark = pages.sparkSession
    known = documents.where("lang is not null").select("lang", "text")
    rows = known.groupBy("lang").count().orderBy("lang").collect()
    languages, prior = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    host = F.lower(F.regexp_extract("url", r"(?s)^.*?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    located = pages.select("page_id", F.nullif(host, F.lit("")).alias("host"), "html")
    if not languages:
        none = F.lit(None).cast("string")
        return located.select(
            "page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"),
            none.alias("declared"), "host",
        )
    counted = known.mapInArrow(_counts, "lang string, trigram int, n bigint").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))
    blocks = [languages[i : i + BLOCK_LANGUAGES] for i in range(0, len(languages), BLOCK_LANGUAGES)]
    counted = cut(counted, "trigrams") if len(blocks) > 1 else counted
    kind, page = (pages.schema[name].dataType.simpleString() for name in ("page_id", "html"))
    evidence = located
    for number, block in enumerate(blocks):
        first, last = number == 0, number == len(blocks) - 1
        # Columns, not rows: at most as many numbers as the table itself has.
        own = counted.where(F.col("lang").between(block[0], block[-1])).select("lang", "trigram", "n").toArrow()
        place, counts = {lang: i for i, lang in enumerate(block)}, np.zeros((len(block), TRIGRAMS))
        named = own.column("lang").combine_chunks().dictionary_encode()
        rows_of = np.array([place[lang] for lang in named.dictionary.to_pylist()], np.int64)[named.indices.to_numpy()]
        counts[rows_of, own.column("trigram").to_numpy()] = own.column("n").to_numpy()
        table = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * TRIGRAMS))
        schema = f"page_id {kind}, host string, declared string, likely array<double>" + ("" if last else f", html {page}")
        # Written between passes, so that one block is held at a time.
        evidence = evidence if first else cut(evidence, "likelihoods")
        evidence = evidence.mapInArrow(_evidence(spark.sparkContext.broadcast(table), first, last), schema)
    labels = F.split("host", r"\.")
    scaled = F.transform("likely", lambda x: x * TEMPER)
    start = F.array(*[F.lit(float(x)) for x in np.log(prior / prior.sum())])
    evidence = evidence.select(
        "page_id", "host", "declared", scaled.alias("text"),
        F.element_at(labels, -1).alias("suffix"),
        F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("host")).alias("domain"),
    )
    judged = cut(evidence.withColumn("posterior", _softmax(_plus(F.col("text"), start))), "text_evidence")
    n = len(languages)
    everywhere = judged.agg(*[F.sum(F.col("posterior")[i]) for i in range(n)], F.count("*")).first()
    overall = np.array([x or 0.0 for x in everywhere[:n]]) + 1e-3
    share = F.array(*[F.lit(float(x)) for x in overall / overall.sum()])
    by_language = F.array(*[F.lit(float(x)) for x in overall])
    joined = judged
    for key in ("host", "domain", "suffix", "declared"):
        joined = joined.join(_group_counts(judged, key, n, f"{key}_pages"), key, "left")

    def narrowed(key: str, wider: Column) -> Column:
        """The wider prior, moved by what other pages of the group are."""
        others = F.zip_with(f"{key}_pages", "posterior", lambda x, y: F.greatest(x - y, F.lit(0.0)))
        size = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
        own = F.zip_with(others, wider, lambda x, y: (x + SMOOTHING * y) / (size + SMOOTHING))
        return F.when(F.col(f"{key}_pages").isNull(), wider).otherwise(own)

    def stated(key: str) -> Column:
        """Logarithm of the chance that a page of each language has this value."""
        chance = F.zip_with(f"{key}_pages", by_language, lambda x, y: F.log((x + 0.5) / (y + 1.0)))
        return F.when(F.col(f"{key}_pages").isNull(), F.transform(by_language, lambda _: F.lit(0.0))).otherwise(chance)

    host_prior = narrowed("host", narrowed("domain", share))
    logs = _plus(_plus(F.col("text"), F.transform(host_prior, lambda x: F.log(x + 1e-9))), _plus(stated("declared"), stated("suffix")))
    fused = joined.withColumn("fused", _softmax(logs))
    name = lambda c: F.array(*[F.lit(x) for x in languages])[F.array_position(c, F.array_max(c)).cast("int") - 1]
    return fused.select(
        "page_id", name(F.col("fused")).alias("lang"), F.array_max("fused").alias("confidence"),
        name(F.col("posterior")).alias("text_lang"), "declared", "host",
    )
