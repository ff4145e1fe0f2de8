"""URL filters, top-k search, WARC, packing, quality, language and the pipeline."""

import base64
import hashlib
import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import quality, topk_search, warc
from ledgerloom.llm.language_id import language_id, plain_text
from ledgerloom.llm.packing import boundaries, pack, with_texts
from ledgerloom.llm.url_filter import url_filter

# ---------------------------------------------------------------- URL filters


def judged(url, rules, default):
    at = (url or "").find("://")
    host = path = ""
    if at >= 0:
        parts = re.match(r"(?s)([^/?#]*)([^?#]*)", url[at + 3 :])
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), parts[1]), parts[2]
    best = None
    for rule, verdict in rules:
        rule_host, rule_path = (rule or "").partition("/")[0], (rule or "")[len((rule or "").partition("/")[0]) :]
        if rule_host and (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            best = max(best or (0, 0, "", ""), (len(rule), len(rule_host), rule, verdict))
    return host, path, best[2] if best else None, best[3] if best else default


def test_verdicts_are_those_of_the_longest_rule(spark):
    rng = random.Random(3)
    labels, paths = ["a", "b", "ab", "com", "", "é"], ["", "/", "/a", "/a/", "/ab", "/é", "/a?x", "/A#/z", "/a\nb"]
    rules = [
        (".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "/a", "/a/", "/ab", "/é"]),
         rng.choice(["allow", "block"])) for _ in range(60)
    ]
    rules += [(None, "block"), ("/a", "block"), rules[0]]
    urls = [
        (i, rng.choice(["http://", "", "x://y://", "HTTP://"])
         + ".".join(rng.choice([*labels, "COM", "zz"]) for _ in range(rng.randint(1, 5))) + rng.choice(paths), "h")
        for i in range(400)
    ] + [(None, None, None), (5, "", "x"), (5, "", "x"), (6, "a.com", None), (7, "s://" + "a." * 3000 + "com/a", None)]
    pages = spark.createDataFrame(urls, "id bigint, url string, host string").repartition(3)
    table = spark.createDataFrame(rules, "rule string, verdict string")
    got = url_filter(pages, table, "neither").select("page.id", "page.url", "judged.*")
    want = sorted(((i, u, *judged(u, rules, "neither")) for i, u, _ in urls), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {r[0] for r in url_filter(pages, table.limit(0), "neither").select("judged.verdict").collect()} == {"neither"}
    assert url_filter(pages.limit(0), table).count() == 0


def test_url_filter_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "id bigint, url string")
    rules = spark.createDataFrame([("b/", "block")], "rule string, verdict string")
    plan = url_filter(pages, rules)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", plan)


# ---------------------------------------------------------------- top-k search


@pytest.mark.parametrize("shard,leaf,block", [(1 << 20, 64, 4 << 20), (240, 4, 300)])
def test_nearest_are_those_of_all_pairs(spark, monkeypatch, shard, leaf, block):
    monkeypatch.setattr(topk_search, "SHARD_VALUES", shard)
    monkeypatch.setattr(topk_search, "LEAF_ROWS", leaf)
    monkeypatch.setattr(topk_search, "BLOCK_VALUES", block)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(300, 5)), 1))]
    rows += [(300 + i, rows[7][1]) for i in range(20)] + [(7, rows[7][1]), (7, rows[8][1]), (100, rows[7][1]), (150, [99.0] * 5), (-50, [0.0] * 5), (1000, [1e155, -1e200, 1.0, 0.0, 0.0])]
    rows += [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0]), (500, [float("nan")] * 5), (550, [float("inf")] + [0.0] * 4),
             (600, [1.0, 2.0]), (601, [3.0, -1.0]), (650, []), (651, []), (None, [1.0] * 5)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, score string, rank int")
    got = topk_search.top_k(table.repartition(4), F.col("vec_id") % 50 == 0, k=5, scale=256)
    usable = [
        (i, [int(np.floor(x * 256)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    want = []
    for at, (q, a) in enumerate(usable):
        if q % 50 == 0:
            scores = [
                (max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), i)
                for other, (i, b) in enumerate(usable) if other != at and len(a) == len(b)
            ]
            best = sorted(scores, key=lambda s: (-s[0], s[1]))[:5]
            want += [(q, n, i, s) for n, (s, i) in enumerate(best, start=1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk_search.top_k(none, F.col("vec_id") % 50 == 0).count() == 0


# ---------------------------------------------------------------- WARC


@pytest.mark.parametrize("chunk,least", [(1 << 20, 0), (7, 0), (7, 6)])
def test_archives_give_back_what_was_written(spark, monkeypatch, chunk, least):
    monkeypatch.setattr(warc, "CHUNK_BYTES", chunk)
    rng = random.Random(1)
    rows = [(1, "u\r\n%", ""), (2, None, None), (3, "x", "abc\n"), (4, "x", "\n\n"), (5, "x", "é" * 50 + "\r\n\r\nWARC/1.1\r\n"),
            (6, "x", "abc\n"), (6, "x", "abc\n"), (None, "q", "abc\n"), (None, "q", "only here"), (7, "", "𐍈" * 31), (8, "x", "\r"),
            (9, "x", "\r\n\r\n"), (10, "x", "Content-Length: 5\r\n\r\nx" * 3)]
    rows += [(-5, "n", "minus"), (-4, "n", "minus"), (121, "n", "minus")]
    rows += [(i, "z", "".join(rng.choice("a\n\ré\0") for _ in range(rng.randrange(40)))) for i in range(11, 120)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    records = warc.warc_round_trip(pages.repartition(3), least)
    got = records.select(number("record_id"), "bytes", "digest", "kind", number("refers_to"), "error").collect()
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, _, html in rows:
        payload, owner = (html or "").encode(), first.get(html or "")
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        again = owner is not None and owner != i
        want.append((i, len(payload), digest, "revisit" if again else "response", owner if again else None, None))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1 << 20, 64, 7])
def test_chunk_rows_give_payloads_back(spark, monkeypatch, tmp_path, chunk):
    """Payloads as (record, chunk number) rows, each with the digest of the payload up to it."""
    monkeypatch.setattr(warc, "CHUNK_BYTES", chunk)
    rows = [(i, "u", ("é\r\n" if i % 3 else "ab\n") * i) for i in range(40)] + [(-7, "u", "x" * 500), (50, None, None)]
    warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path / "w"))
    found = {}
    for row in warc.read_chunks(spark, str(tmp_path / "w")).where("kind = 'response'").collect():
        found.setdefault(row.record_id, {})[row.chunk] = row
    assert set(found) == {f"urn:page:{i}" for i, _, _ in rows if i != 50}
    for i, _, html in rows:
        if i == 50:
            continue
        parts, payload = found[f"urn:page:{i}"], b""
        assert sorted(parts) == list(range(1, len(parts) + 1)) and [n for n in parts if parts[n].end] == [len(parts)]
        for number in sorted(parts):
            payload += parts[number].payload
            assert len(parts[number].payload) <= chunk and parts[number].bytes == len(payload)
            assert parts[number].digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert payload == (html or "").encode()


def test_archives_are_plain_warc(spark, tmp_path):
    import gzip

    warc.write_warc(spark.createDataFrame([(1, "http://a/", "<p>hé</p>")], "page_id bigint, url string, html string"), str(tmp_path / "w"))
    text = b"".join(gzip.open(p).read() for p in (tmp_path / "w").glob("*.gz"))
    head, _, block = text.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", head)[1])
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and block[length:] == b"\r\n\r\n"
    assert block[:length].split(b"\r\n\r\n")[1] == "<p>hé</p>".encode()


def test_damaged_records_are_reported(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(
        b"junk\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\n"
        b"WARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n"
        b"WARC/1.1\r\nWARC-Type: continuation\r\nWARC-Record-ID: <urn:x>\r\nWARC-Segment-Origin-ID: <urn:page:2>\r\n"
        b"WARC-Segment-Number: 2\r\nWARC-Segment-Total-Length: 9\r\nContent-Length: 1\r\n\r\nz\r\n\r\n"
    )
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r["error"].split(":")[0] for r in got) == ["digest differs", "not a record", "segments apart"]
    assert {r["record_id"]: r["bytes"] for r in got if r["record_id"]} == {"urn:page:1": 3, "urn:page:2": 1}


# ---------------------------------------------------------------- packing


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= size) - size) for size, n in histogram.items())


def test_boundaries_have_the_least_padding():
    rng = random.Random(1)
    for _ in range(200):
        histogram = {rng.randint(1, 30): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
        buckets, sizes = rng.randint(1, 5), sorted(histogram)
        found = boundaries(histogram, buckets)
        best = min(
            padding(histogram, (*inner, sizes[-1]))
            for n in range(min(buckets, len(sizes)))
            for inner in itertools.combinations(sizes[:-1], n)
        )
        assert padding(histogram, found) == best and len(found) <= buckets
    assert boundaries({}, 4) == []


def test_batches_hold_every_token_once(awkward):
    rows, docs = awkward
    packed = pack(docs, longest=64, buckets=4, budget=256)
    got = packed.collect()
    words = {}
    for i, text in rows:
        words.setdefault(i, []).append(re.findall("[^\\x20\\x09-\\x0D]+", text or ""))
    assert sum(r["n_tokens"] for r in got) == sum(len(w) for own in words.values() for w in own)
    batches = {}
    for r in got:
        assert r["n_tokens"] <= r["bucket"] and r["padding"] == r["bucket"] - r["n_tokens"] and r["start"] == 64 * r["piece"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["slot"])
    for (bucket, batch), slots in batches.items():
        most = max(1, 256 // bucket)
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= most
        assert len(slots) == most or (bucket, batch + 1) not in batches
    for r in with_texts(packed, docs).collect():
        piece = re.findall("[^\\x20\\x09-\\x0D]+", r["text"])
        assert any(own[r["start"] : r["start"] + r["n_tokens"]] == piece for own in words[r["doc_id"]])
    assert pack(docs.limit(0)).count() == 0 and pack(docs.where("text is null")).count() == 0


# ---------------------------------------------------------------- quality


def test_em_finds_classes_and_accuracies():
    rng = random.Random(2)
    counts, truth = {}, []
    for _ in range(4000):
        yes = rng.random() < 0.2
        votes = ""
        for right in (0.9, 0.8, 0.85, 0.7):
            vote = (2 if yes else 1) if rng.random() < right else (1 if yes else 2)
            votes += "0" if rng.random() < 0.2 else str(vote)
        counts[votes] = counts.get(votes, 0) + 1
        truth.append((votes, yes))
    found = quality.posteriors(counts)
    assert sum((found[votes] > 0.5) == yes for votes, yes in truth) > 0.9 * len(truth)
    assert quality.posteriors({}) == {}


def test_rejected_documents_are_junk_or_toxic(spark, awkward):
    rng = random.Random(9)
    parts = ("ka", "lo", "mi", "ter", "an", "ra", "do", "s", "n", "tion", "be")
    words = [a + b + c for a in parts for b in parts for c in parts]
    function = ["the", "of", "and", "to", "in", "a", "is"]

    def prose(n):
        return " ".join(rng.choice(function) if rng.random() < 0.3 else rng.choice(words) for _ in range(n)).capitalize() + "."

    rows, labels, truth = [], [], {}
    for i in range(900):
        text, kind = prose(rng.randrange(40, 200)), rng.choice(["clean"] * 5 + ["junk", "toxic"])
        if kind == "junk":
            text = rng.choice([text.upper().replace(" ", "!! "), " | ".join(text.split()), "Wort " * 80, text.replace(" ", "%%% ")])
        if kind == "toxic":
            own = text.split()
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["vilewort", "badwort", "awfulwort"]))
            text = " ".join(own)
        rows.append((i, text, "x"))
        truth[i] = kind
        if i % 2 == 0:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, votes string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, table).collect()}
    assert len(got) == 900
    assert sum(got[i] == (kind == "clean") for i, kind in truth.items()) > 0.97 * 900
    assert all(got[i] for i, kind in truth.items() if kind == "clean" and i % 2) or (
        sum(not got[i] for i, kind in truth.items() if kind == "clean") <= 3
    )
    assert not any(got[i] for i, kind in truth.items() if kind == "toxic")


def test_quality_without_labels_and_on_awkward_rows(spark, awkward):
    rows, docs = awkward
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert len(got) == len(rows)
    assert all(not r["keep"] for r in got if r["n_words"] == 0) and all(r["toxic_score"] <= 0 for r in got)
    assert quality.classify(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- language


def test_plain_text_drops_markup():
    html = b"<!-- a > b --><p class='x'>one</p><script>var a = '<p>';</script>two<STYLE>p{}</style> three < four <script>rest"
    assert plain_text(html).split() == [b"b", b"-->", b"one", b"two", b"three"] or plain_text(html).split()[-2:] == [b"two", b"three"]
    assert plain_text(b"") == b"" and plain_text(b"no tags") == b"no tags"


def test_evidence_decides_what_the_text_leaves_open(spark):
    rng = random.Random(6)
    stems = {"en": ["the", "th", "ing", "wh"], "de": ["sch", "ung", "der", "keit"]}

    def prose(lang, n=60):
        return " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    docs = spark.createDataFrame([(prose(x), x, "h") for x in ("en", "de") for _ in range(40)] + [(None, "en", "h"), ("zzz", None, "h")],
                                 "text string, lang string, host string")
    rows = []
    for i in range(200):
        lang = "de" if i % 2 else "en"
        told = {"de": "en", "en": "de"}[lang] if i % 20 < 2 else lang
        rows.append((i, f"http://{'a' if i % 2 else 'b'}.site.{lang}/x", f'<html lang="{told}"><p>{prose(lang)}</p></html>', "x"))
    rows += [(300, "http://a.site.de/", "", "x"), (301, "http://b.site.en/", None, "x"), (302, None, f"<p>{prose('de')}</p>", "x"),
             (303, None, None, "x"), (None, "nothing", '<html LANG=de><p>123</p>', "x"), (1, rows[1][1], rows[1][2], "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, lang string").repartition(3)
    got = language_id(pages, docs).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r["lang"] for r in got}
    assert all(by_id[i] == ("de" if i % 2 else "en") for i in range(200))
    assert (by_id[300], by_id[301], by_id[302], by_id[None]) == ("de", "en", "de", "de")
    assert {r["lang"] for r in language_id(pages, docs.limit(0)).collect()} == {None}
    assert language_id(pages.limit(0), docs).count() == 0


# ---------------------------------------------------------------- pipeline


def test_every_stage_takes_awkward_rows(spark, awkward, tmp_path):
    rows, docs = awkward
    folder = str(tmp_path)
    spark.createDataFrame([(100, 1, 0), (101, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    text = dict(rows)[100]
    spark.createDataFrame([(1, text)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            got = stage(spark, given, folder)
            if name != "packing":
                assert got.columns == docs.columns
            ids = {r["doc_id"] for r in got.collect()}
            if name == "near_duplicates" and given is docs:
                assert 403 in ids and 404 not in ids and {400, 401, 402, None} <= ids and 301 not in ids
            if name == "contamination" and given is docs:
                assert 100 not in ids and 200 in ids


def test_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "repeated_passages", "contamination", "packing",
    ]


def test_near_duplicates_go_by_text_and_not_by_id(spark, tmp_path):
    """Rows of one id with other texts stay, rows without an id take part, equal rows stay once, wordless ones always."""
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join(["new", *words[1:]])
    other, third = " ".join(reversed(words)), " ".join(sorted(words))
    rows = [(5, text, "a"), (5, other, "b"), (7, near, "c"), (None, text, "d"), (None, third, "e"), (9, third, "f"),
            (None, other + " x", "g"), (3, "", "h"), (3, "", "i"), (4, None, "j"), (5, text, "k"), (8, "short text", "l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_id string")
    got = sorted(r.row_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    assert got in (sorted("bfhijl" + one) for one in "ak")
    empty = corpus_pipeline.near_duplicates(spark, docs.limit(0), str(tmp_path))
    assert empty.collect() == [] and empty.columns == docs.columns


def test_a_run_outlives_the_next(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no data folder")
    first = corpus_pipeline.run(spark, folder)
    second = corpus_pipeline.run(spark, folder)
    assert sorted(first.collect()) == sorted(second.collect())
