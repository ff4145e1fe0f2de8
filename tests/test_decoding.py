"""Protected columns are decoded once for each stored value."""

from pyspark.sql import functions as F

from ledgerloom.functions.columns import aes_decoder, aes_encode
from ledgerloom.operators import decoding
from ledgerloom.session import cut

KEY = "0123456789abcdef"


def test_each_stored_value_is_decoded_once(spark, monkeypatch):
    plans = []

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return cut(df, name)

    monkeypatch.setattr(decoding, "cut", seen)
    rows = spark.range(60).selectExpr(
        "id", "concat('a', id % 7) as account", "if(id % 5 = 0, null, concat('m', id % 3)) as amount"
    )
    stored = rows.select("id", *[aes_encode(F.col(c), KEY).alias(c) for c in ("account", "amount")])
    stored = cut(stored.withColumn("amount", F.when(F.col("id") == 1, "broken").otherwise(F.col("amount"))), "stored")
    dictionary = decoding.decode_dictionary(stored, "t", ["account", "amount"], aes_decoder(KEY), "unreadable")
    assert dictionary.count() == 7 + 3 + 1
    decodes = [plan.lower().count("aes_decrypt") + plan.lower().count("aesdecrypt") for _, plan in plans]
    assert [name for name, _ in plans] == ["stored_values", "decode_dictionary"]
    assert decodes[0] == 0 and decodes[1] > 0 and "Aggregate" not in plans[1][1]
    found = decoding.with_decoded(stored, dictionary, ["account", "amount"])
    assert "aes" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.id: (r.clear_account, r.clear_amount) for r in found.collect()}
    want = {r.id: (r.account, r.amount) for r in rows.collect()}
    assert got == want | {1: ("a1", "unreadable")} and len(got) == 60
