"""Token alignment against plain Python over the tokenizers' own results."""

import hashlib
import os
import random
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import queries
from ledgerloom.llm import token_alignment as module
from ledgerloom.llm.token_alignment import Aligner, align_tokens, aligned_texts, linkable, pair_counts

FILES = f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(FILES[0]), reason="no vocabulary files")


@pytest.fixture(scope="module")
def tokenizers():
    own = Tokenizer.from_file(FILES[0])
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def byte_entries():
    """The byte-level characters of a vocabulary, and the bytes they stand for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


CHARACTERS = byte_entries()


def plain_alignment(text, own, pieces):
    """A's and B's ids, groups and links of a text; None without tokens."""
    if not text:
        return None
    a, b = own.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    of_a = [bytes(CHARACTERS[c] for c in own.id_to_token(i)) for i in a]
    of_b = []
    for i in b:
        piece = pieces.id_to_piece(i)
        of_b.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode())
    whole = b" " + text.encode()
    if b"".join(of_a) != whole or b"".join(of_b) != whole:
        return None
    groups, links, k, x, y, left, right = [], [], 0, 0, 0, [], []
    for i, entry in zip(a, of_a):
        x += len(entry)
        left.append(i)
        while y < x:
            y += len(of_b[k])
            right.append(b[k])
            k += 1
        if x == y:
            groups.append((left, right))
            links.append((i, b[k - 1]))
            left, right = [], []
    return a, b, groups, links


def expected(rows, tokenizers):
    found = [plain_alignment(text, *tokenizers) for _, text in rows]
    counts = Counter(link for f in found if f for link in f[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), f in zip(rows, found):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[link] == most[link[1]] for link in links)
        out.append((i, len(a), len(b), len(groups), len(links), best, sum(counts[link] for link in links),
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(table):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(row) for row in table.select(*names).collect()), key=str)


ODD = ["\0a b", "<s> hi </s> <unk> <0x41> <|endoftext|>", "▁x y", "  two  spaces ", " \n", "　x", "é Å Å",
       "ﬁ ﬃ", "😀 x 👩‍👩‍👧", "\r\n a", "nb sp", "don't I'll", "日本語 ไทย العربية", "a" * 9000, "\n" * 5000, " " * 9000 + "x"]


def test_rows_are_those_of_plain_python(spark, awkward, tokenizers):
    rows, docs = awkward
    odd = [(1000 + n, text) for n, text in enumerate(ODD)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"), allowMissingColumns=True)
    assert rows_of(align_tokens(docs, *FILES)) == expected(rows + odd, tokenizers)


def test_counts_add_up(awkward):
    _, docs = awkward
    aligned = aligned_texts(docs, *FILES)
    a_ids, b_ids = linkable(*FILES)
    counts, best = pair_counts(aligned, b_ids)
    assert counts.sum() == aligned.selectExpr("sum(size(links))").first()[0]
    assert set(b_ids[counts > 0]) == set(b_ids[best & (counts > 0)])
    aligner = module._aligner(*FILES)
    assert len(a_ids) <= 2 * (aligner.a.sizes.sum() + aligner.b.sizes.sum())


def test_long_texts_are_cut_where_no_token_can_be(tokenizers, monkeypatch):
    monkeypatch.setattr(module, "PIECE", 20)
    aligner, rng = Aligner(*FILES), random.Random(2)
    words = ["the", "Straße", "x1", "(see", "it's", "été", "\n\nnew", "7", "日本", "  pad"]
    for _ in range(30):
        text = " ".join(rng.choice(words) for _ in range(80))
        parts = aligner.parts(text)
        assert " ".join(parts) == text and len(parts) > 1
        ids = aligner.encoded(parts)
        assert [i for a, _ in ids for i in a] == tokenizers[0].encode(" " + text, add_special_tokens=False).ids
        assert [i for _, b in ids for i in b] == tokenizers[1].encode(text)
        of_parts = aligner.aligned(parts)
        of_text = aligner.aligned([text])[0]
        assert ";".join(part[2] for part in of_parts) == of_text[2]


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'slaE1.,-éß")), max_size=60))
def test_any_text(text):
    own = Tokenizer.from_file(FILES[0]) if not hasattr(test_any_text, "kept") else test_any_text.kept[0]
    if not hasattr(test_any_text, "kept"):
        own.encode_special_tokens = True
        test_any_text.kept = own, sentencepiece.SentencePieceProcessor(model_file=FILES[1]), Aligner(*FILES)
    own, pieces, aligner = test_any_text.kept
    want = plain_alignment(text, own, pieces)
    got = aligner.aligned([text])[0] if text else None
    if want is None:
        assert got is None
    else:
        assert got[:2] == (len(want[0]), len(want[1])) and aligner.pairs[got[3]].tolist() == [a << 32 | b for a, b in want[3]]


def test_empty_table(spark):
    assert align_tokens(spark.createDataFrame([], "doc_id bigint, text string"), *FILES).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert rows_of(align_tokens(nothing, *FILES)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_registered_query(spark, tmp_path, tokenizers):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma.", "delta", "Über", "x", "42"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(60)] + [(70, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows_of(queries.op11_token_alignment(spark, str(tmp_path))) == expected(rows, tokenizers)
