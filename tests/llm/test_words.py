import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.words import ALNUM, SPACED, grams, slices, whole, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ \n\té0_\x0b |ñ", max_size=40)), max_size=8)


def plain(text, pattern):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(pattern, lowered)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    for kind, pattern in ((SPACED, "[^\\x20\\x09-\\x0D]+"), (ALNUM, "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")):
        found = words(pa.array(texts, pa.string()), kind)
        expected = [plain(t, pattern) for t in texts]
        assert found.counts.tolist() == [len(e) for e in expected]
        names = {}
        for word, value in zip([w for e in expected for w in e], found.hashes.tolist()):
            assert names.setdefault(word, value) == value
        assert len(set(names.values())) == len(names)
        cut_out = [bytes(found.data[a:b]).decode() for a, b in zip(found.starts, found.ends)]
        assert [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in cut_out] == [w for e in expected for w in e]


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_equal_grams_are_equal_words(texts, n):
    found = words(pa.array(texts, pa.string()))
    expected = [plain(t, "[^\\x20\\x09-\\x0D]+") for t in texts]
    at = whole(found.first, n)
    values = grams(found.hashes, n)[at] if len(at) else np.empty(0, np.uint64)
    runs = [tuple(e[i : i + n]) for e in expected for i in range(len(e) - n + 1)]
    assert len(runs) == len(values)
    names = {}
    for run, value in zip(runs, values.tolist()):
        assert names.setdefault(run, value) == value
    assert len(set(names.values())) == len(names)


def test_long_words_and_sliced_arrays():
    text = "a" * 200_000 + " b " + "a" * 200_000
    found = words(pa.array(["x", text, None, text], pa.string()).slice(1))
    assert found.counts.tolist() == [3, 0, 3]
    assert found.hashes[0] == found.hashes[2] == found.hashes[3] != found.hashes[1]


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 5, 50, 1, 1, 1, 70, 2)] + [None]})
    cut = list(slices(iter([batch]), "text", limit=20))
    assert [x for part in cut for x in part.column("text").to_pylist()] == batch.column("text").to_pylist()
