import random

import pytest

#: Names that the operators use inside; extra columns may have them too.
EXTRA = ["row_hash", "file", "node", "spans", "window_a", "low", "removed", "n_words", "score", "row", "rank", "slice"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with NULLs, empty, very long and equal texts, near copies, shared passages and clashing extra columns."""
    rng = random.Random(5)
    vocabulary = ["ab", "The", "ñu", "x|y", "Σig", "don't", "42", "q", "zé", "LO", "w.", "k%"] + [f"w{i}" for i in range(80)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, long = prose(70), prose(6000)
    base = [prose(rng.randrange(20, 160)) for _ in range(12)]
    rows = [(i, text) for i, text in enumerate(base, start=100)]
    for n, text in enumerate(base[:8]):
        words = text.split(" ")
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((50 + n, "\n".join(words)))
    rows += [(200 + i, prose(30) + "\t" + passage + "  " + prose(20)) for i in range(5)]
    rows += [(300, long), (301, long), (2, long + " tail"), (400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "ONE"),
             (405, "two words"), (406, "a b c"), (407, "A  B\nC"), (103, base[3]), (103, base[3]), (103, "other text here"),
             (None, base[2]), (None, None), (500, "x" * 70000 + " y"), (501, "nbsp here  x"), (502, "nul\0in\x1ftext")]
    names = ["doc_id", "text", *EXTRA]
    schema = "doc_id bigint, text string, " + ", ".join(f"{name} string" for name in EXTRA)
    data = [(i, t, *[f"e{k}" for k in range(len(EXTRA))]) for i, t in rows]
    assert len(data[0]) == len(names)
    return rows, spark.createDataFrame(data, schema).repartition(3)
