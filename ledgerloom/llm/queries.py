"""The operators applied to the given tables with production parameters, and the SQL they are checked against."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.decontaminate import decontaminate
from ledgerloom.llm.jaccard_join import jaccard_join
from ledgerloom.llm.language_id import language_id
from ledgerloom.llm.lm_score import lm_score
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality import classify
from ledgerloom.llm.simhash import simhash
from ledgerloom.llm.substring_dedup import substring_dedup
from ledgerloom.llm.token_alignment import align_tokens
from ledgerloom.llm.topk_search import top_k
from ledgerloom.llm.url_filter import url_filter
from ledgerloom.llm.warc import warc_round_trip
from ledgerloom.llm.whitening import whiten


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document for junk and toxicity, and whether it is kept."""
    found = classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return found.select("doc_id", "n_words", "junk_votes", "toxic_votes", "junk_score", "toxic_score", "keep")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The batch and slot of every piece of every document."""
    packed = pack(_table(spark, folder, "documents"), longest=2048, buckets=16, budget=32_768)
    return packed.drop("row_hash")


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every page, learnt from all documents."""
    return language_id(_table(spark, folder, "pages"), _table(spark, folder, "documents"))


#: Rule and verdict.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict of the rules on every page."""
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    judged = url_filter(_table(spark, folder, "pages").select("page_id", "url"), rules, default="allow")
    return judged.select("page.page_id", "judged.*")


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in a 13-word window of a benchmark item."""
    found = decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), n=13, share=20)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Bigram scores of all documents; a seventh of them, by a checksum of the id, is not learnt from."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_score(_table(spark, folder, "documents"), held_out)


def op4_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest vectors by inner product of every vector whose id is divisible by 50."""
    return top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all pages as read back from the archives they were written to."""
    records = warc_round_trip(_table(spark, folder, "pages"), least=0)
    number = lambda name: F.regexp_extract(name, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    return records.select(
        number("record_id").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        number("refers_to").alias("refers_to"),
        "error",
    )


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_join(_table(spark, folder, "documents"), shingle=3, similarity=Fraction(9, 10))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words left of every document without the 50-word windows that a document of smaller id holds."""
    found = substring_dedup(_table(spark, folder, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The folder of the vocabulary files, on every executor.
TOKENIZERS = "/opt/tokenizers"


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of the tokens of all documents by two tokenizers."""
    files = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
    return align_tokens(_table(spark, folder, "documents"), *files)


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and the components of those that differ in at most three bits."""
    return simhash(_table(spark, folder, "documents"), shingle=3)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The four first whitened principal components of every embedding."""
    return whiten(_table(spark, folder, "embeddings"), components=4, scale=256)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_decontaminate": op2_decontaminate,
    "op3_lm_score": op3_lm_score,
    "op4_topk_search": op4_topk_search,
    "op5_warc": op5_warc,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_token_alignment": op11_token_alignment,
    "op12_simhash": op12_simhash,
    "op13_whitening": op13_whitening,
}

_RULE_ROWS = ", ".join(
    "('{}', '{}', '{}', '{}')".format(rule, rule.partition("/")[0], "/" + rule.partition("/")[2], verdict)
    for rule, verdict in URL_RULES
)
_ALNUM, _SPACED = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "[^\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op1_url_filter": f"""
        WITH rules(rule, rule_host, rule_path, verdict) AS (VALUES {_RULE_ROWS}),
        located AS (
            SELECT page_id,
                coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        )
        SELECT page_id, host, path,
            (SELECT arg_max(rule, length(rule)) FROM rules
             WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
            coalesce((SELECT arg_max(verdict, length(rule)) FROM rules
             WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)), 'allow')
             AS verdict
        FROM located
    """,
    "op2_decontaminate": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS rid, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w
            FROM documents),
        items AS (
            SELECT CAST(item_id AS VARCHAR) AS item, w, least(13, len(w)) AS size FROM (
                SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w
                FROM benchmark) WHERE len(w) > 0),
        windows AS (
            SELECT DISTINCT item, size, array_to_string(w[p : p + size - 1], ' ') AS k
            FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM items)),
        places AS (
            SELECT rid, p, size, array_to_string(w[p : p + size - 1], ' ') AS k
            FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS p
                  FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
        found AS (SELECT rid, p, size, item FROM places JOIN windows USING (size, k)),
        hit AS (SELECT rid, count(DISTINCT pos_) AS n FROM (SELECT rid, unnest(range(p, p + size)) AS pos_ FROM found) GROUP BY rid),
        named AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
            sha256(coalesce(i.items, '')) AS items_sha256,
            coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
        FROM docs LEFT JOIN hit h USING (rid) LEFT JOIN named i USING (rid)
    """,
    "op4_topk_search": """
        WITH v AS (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x : floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x : x IS NULL OR NOT isfinite(x)))),
        scored AS (
            SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rid <> c.rid)
        SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
        WINDOW best AS (PARTITION BY rid ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 5
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        o AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
                ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31) + 1
                AS BIGINT), 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
        FROM o
    """,
    "op6_jaccard_join": f"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACED}') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM docs WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
            GROUP BY ALL),
        links AS (
            SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * p.n >= 90 * (x.n + y.n - p.n)),
        ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT a AS doc_id, a AS root FROM ends UNION SELECT b.b, r.root FROM reach r JOIN ends b ON b.a = r.doc_id)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
        FROM docs d LEFT JOIN sizes s USING (doc_id)
        LEFT JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r USING (doc_id)
    """,
    "op7_substring_dedup": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
        windows AS (
            SELECT rid, doc_id, p, array_to_string(w[p : p + 49], ' ') AS k
            FROM (SELECT *, unnest(range(1, len(w) - 48)) AS p FROM docs WHERE len(w) >= 50)),
        first AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k),
        gone AS (
            SELECT DISTINCT rid, unnest(range(p, p + 50)) AS pos_ FROM windows JOIN first USING (k) WHERE low < doc_id),
        kept AS (
            SELECT rid, string_agg(word, ' ' ORDER BY pos_) AS text
            FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos_ FROM docs) x ANTI JOIN gone USING (rid, pos_)
            GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM docs LEFT JOIN (SELECT rid, count(*) AS n FROM gone GROUP BY rid) g USING (rid) LEFT JOIN kept k USING (rid)
    """,
}
