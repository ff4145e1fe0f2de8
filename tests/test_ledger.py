"""The import ledger: only what is new, changed or superseded since comes out."""

from datetime import datetime

from ledgerloom.plans import ledger

VERSIONS = "run_id string, table_name string, created_at timestamp_ntz, contract_json string"


def versions(spark, *rows):
    return spark.createDataFrame([(r, t, datetime(2024, 1, day), text) for r, t, day, text in rows], VERSIONS)


def taken(table, seen):
    return sorted(((r.kind, r.identity, r.change) for r in ledger.take_in(table, seen).collect()), key=str)


def made(spark, tmp_path):
    table = ledger.ledger_table(spark, str(tmp_path / "ledger"), parts=8)
    table.create(spark.createDataFrame([], ledger.SCHEMA))
    return table


def hash_of(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_only_differences_come_out(spark, tmp_path):
    table = made(spark, tmp_path)
    first = versions(spark, ("r1", "t", 1, "a"), ("r2", "u", 1, "b"), ("r3", None, 1, "a"))
    assert taken(table, ledger.observations(first)) == sorted(
        [("run", r, "new") for r in ("r1", "r2", "r3")] + [("table", t, "new") for t in ("t", "u", None)]
        + [("contract", hash_of(c), "new") for c in "ab"], key=str)
    assert taken(table, ledger.observations(first)) == []
    # A newer run of t with another text, one of u with the same text, and r3 with its text changed.
    second = versions(spark, ("r1", "t", 1, "a"), ("r4", "t", 2, "c"), ("r2", "u", 1, "b"), ("r5", "u", 2, "b"), ("r3", None, 1, "d"))
    assert taken(table, ledger.observations(second)) == sorted(
        [("run", "r4", "new"), ("run", "r5", "new"), ("run", "r1", "superseded"), ("run", "r2", "superseded"),
         ("run", "r3", "changed"), ("table", "t", "changed"), ("table", None, "changed"),
         ("contract", hash_of("c"), "new"), ("contract", hash_of("d"), "new")], key=str)
    assert taken(table, ledger.observations(second)) == []
    known = {(r.kind, r.identity): (r.content_hash, r.run_id, r.superseded) for r in table.read().collect()}
    assert known["run", "r1"][2] and known["table", "t"] == (hash_of("c"), "r4", False)
    assert known["contract", hash_of("a")][1] in ("r1", "r3")


def test_evidence_of_a_run_counts(spark, tmp_path):
    table = made(spark, tmp_path)
    rows = versions(spark, ("r1", "t", 1, "a"), ("r2", "u", 1, "b"))
    lineage = spark.createDataFrame([("r1", "x", "y"), ("r1", "y", None), ("r2", "x", "y")], "run_id string, a string, b string")
    assert len(taken(table, ledger.observations(rows, ledger.evidence_hashes(lineage)))) == 6
    again = lineage.orderBy("b").repartition(3)
    assert taken(table, ledger.observations(rows, ledger.evidence_hashes(again))) == []
    more = lineage.unionByName(spark.createDataFrame([("r2", "x", "z")], lineage.schema))
    assert taken(table, ledger.observations(rows, ledger.evidence_hashes(more))) == [("run", "r2", "changed")]


def test_a_part_of_the_runs_touches_a_part_of_the_ledger(spark, tmp_path):
    table = made(spark, tmp_path)
    many = versions(spark, *[(f"r{i}", f"t{i}", 1, f"c{i}") for i in range(40)])
    ledger.take_in(table, ledger.observations(many))
    one = versions(spark, ("r7", "t7", 1, "new"))
    assert taken(table, ledger.observations(one)) == [
        ("contract", hash_of("new"), "new"), ("run", "r7", "changed"), ("table", "t7", "changed"),
    ]
    assert table.read().count() == 121
    assert ledger.take_in(table, ledger.observations(versions(spark))).collect() == []
