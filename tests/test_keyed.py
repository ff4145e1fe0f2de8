"""Keyed tables on disk: merges rewrite only the partitions they touch, and survive being cut off."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import merge
from ledgerloom.session import setting
from ledgerloom.sources.keyed import PART, KeyedTable

RUNS = 200


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(RUNS * 3).selectExpr(
        "concat('r', id div 3) as run_id", "int(id % 3) as pos", "concat('v', id) as value", "cast(null as string) as note"
    )
    made = KeyedTable(spark, str(tmp_path / "t"), rows.schema, ("run_id", "pos"), parts=RUNS, by=("run_id",))
    made.create(rows)
    return made


def files_of(table):
    return {path.rsplit("/", 2)[1]: path for path in table.spark.read.parquet(table.path).inputFiles()}


def test_upsert_touches_few_partitions(spark, table):
    before, files = table.read().collect(), files_of(table)
    delta = spark.createDataFrame([("r7", 1, "new"), ("r9", 5, "more")], "run_id string, pos int, value string")
    want = rows_of(merge.upsert(spark.createDataFrame(before, table.schema), delta, table.keys, {"note": F.lit("n")}))
    touched = table.upsert(delta, {"note": F.lit("n")})
    assert len(touched) <= 2 and rows_of(table.read()) == want
    after = files_of(table)
    changed = {name for name in files if files[name] != after[name]}
    assert changed == {f"{PART}={part}" for part in touched}
    table.upsert(delta, {"note": F.lit("n")})
    assert rows_of(table.read()) == want


def test_reads_only_touched_partitions(spark, table):
    part = table._placed(spark.createDataFrame([("r7",)], "run_id string")).first()[PART]
    read = table._stored(table.path).where(F.col(PART).isin([part]))
    assert "PartitionFilters: [isnotnull(key_part" in read._jdf.queryExecution().toString()
    assert read.select(F.input_file_name()).distinct().count() <= 1


def test_insert_missing_keeps_what_is_there(spark, table):
    delta = spark.createDataFrame([("r1", 0, "x", "n"), ("zz", 0, "y", None)], table.schema)
    before = rows_of(table.read())
    for _ in range(2):
        table.insert_missing(delta)
        assert rows_of(table.read()) == sorted([*before, ("zz", 0, "y", None)], key=str)


def test_slices_are_replaced_and_deleted(spark, table):
    some = table.read().where("run_id in ('r3', 'r4') and pos = 1").withColumn("value", F.lit("again"))
    kept = [row for row in rows_of(table.read()) if row[0] not in ("r3", "r4")]
    assert len(table.replace_slices(some)) <= 2
    assert rows_of(table.read()) == sorted([*kept, ("r3", 1, "again", None), ("r4", 1, "again", None)], key=str)
    for _ in range(2):
        assert len(table.delete_slices(spark.createDataFrame([("r3",), ("r4",), ("none",)], "run_id string"))) <= 3
        assert rows_of(table.read()) == kept


def test_a_table_may_become_empty(spark, table):
    table.delete_slices(table.read())
    assert table.read().collect() == [] and table.read().columns == ["run_id", "pos", "value", "note"]
    table.insert_missing(spark.createDataFrame([("a", 1, "b", "c")], table.schema))
    assert rows_of(table.read()) == [("a", 1, "b", "c")]


def test_nothing_to_change(spark, table):
    files = files_of(table)
    assert table.upsert(spark.createDataFrame([], "run_id string, pos int, value string")) == []
    assert files_of(table) == files


def test_null_keys_are_keys(spark, table):
    delta = spark.createDataFrame([(None, None, "a", None)], table.schema)
    for value in "ab":
        table.upsert(delta.withColumn("value", F.lit(value)))
    table.insert_missing(delta)
    assert rows_of(table.read().where("run_id is null")) == [(None, None, "b", None)]
    table.delete_slices(delta)
    assert table.read().where("run_id is null").collect() == []


def test_a_change_that_was_cut_off(spark, table, monkeypatch):
    """Written but not in place: the next change finishes it. Not written to its end: as if it had not begun."""
    delta = spark.createDataFrame([("r7", 0, "late", None)], table.schema)
    before = rows_of(table.read())
    calls = []

    def stop(self):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return recover(self)

    recover = KeyedTable.recover
    monkeypatch.setattr(KeyedTable, "recover", stop)
    with pytest.raises(KeyboardInterrupt):
        table.upsert(delta)
    monkeypatch.setattr(KeyedTable, "recover", recover)
    assert rows_of(table.read()) == before
    table.upsert(spark.createDataFrame([("r8", 0, "next", None)], table.schema))
    got = {(row[0], row[1]): row[2] for row in rows_of(table.read())}
    assert got["r7", 0] == "late" and got["r8", 0] == "next" and len(got) == len(before)

    spark.createDataFrame([("r9", 0, "torn", None, 1)], table._stored(table.path).schema).write.parquet(f"{table._change}/rows")
    table.recover()
    assert {(row[0], row[1]): row[2] for row in rows_of(table.read())} == got and not table._exists(table._change)


def test_a_change_is_moved_not_written_again(spark, table, monkeypatch):
    """The files of a change become those of the table, also when moving them is cut off in between."""
    delta = spark.range(RUNS).selectExpr("concat('r', id) as run_id", "1 as pos", "'moved' as value")
    gone = spark.createDataFrame([(run,) for run in ("r3", "r4")], "run_id string")
    want = rows_of(merge.upsert(table.read(), delta, table.keys))
    moved, written, move = [], set(), KeyedTable._move

    def stop(self, path, to):
        if not moved:
            written.update(file.rsplit("/", 1)[1] for file in self.spark.read.parquet(f"{self._change}/rows").inputFiles())
        if len(moved) == 3:
            raise KeyboardInterrupt
        moved.append(path)
        move(self, path, to)

    monkeypatch.setattr(KeyedTable, "_move", stop)
    with pytest.raises(KeyboardInterrupt):
        table.upsert(delta)
    monkeypatch.setattr(KeyedTable, "_move", move)
    table.recover()
    assert rows_of(table.read()) == want and not table._exists(table._change)
    assert len(moved) == 3 and written and written <= {file.rsplit("/", 1)[1] for file in files_of(table).values()}
    table.delete_slices(gone)
    assert rows_of(table.read()) == [row for row in want if row[0] not in ("r3", "r4")]


def test_rows_of_the_table_stay_where_they_are(spark, table, monkeypatch):
    """A change is moved and written once, also when it is merged twice; no merge moves rows of either side."""
    delta = spark.createDataFrame([("r7", 1, "new"), (None, 5, "more"), ("zz", None, "b")], "run_id string, pos int, value string")
    want = rows_of(merge.upsert(table.read(), delta, table.keys, {"note": F.lit("n")}))
    plans, lay = [], KeyedTable._lay

    def seen(self, made, path):
        plans.append((path, made._jdf.queryExecution().executedPlan().toString()))
        lay(self, made, path)

    monkeypatch.setattr(KeyedTable, "_lay", seen)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        change = table.staged(
            delta.withColumn("value", F.reverse("value")), lambda moved: moved.withColumn("value", F.reverse("value"))
        )
        assert table.upsert(change, {"note": F.lit("n")}) == table.upsert(change, {"note": F.lit("n")})
        assert rows_of(table.read()) == want
        whole = delta.withColumn("note", F.lit("other"))
        table.insert_missing(whole)
        assert rows_of(table.read()) == want
        table.replace_slices(whole)
        table.delete_slices(whole)
    merges = [plan for path, plan in plans if path.endswith("/rows")]
    assert len(plans) == 9 and len(merges) == 5 and not any("Exchange" in plan for plan in merges)
    assert {"r7", "zz", None}.isdisjoint(row[0] for row in rows_of(table.read()))
