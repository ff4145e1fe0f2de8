"""Published tables: statistics that the optimizer uses, listings by executors."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.session import apply_settings, cut, setting
from ledgerloom.sources import tables, text
from suite.lab import Lab
from suite.warehouse import Published, bucketed_portfolio


def test_statistics_change_the_order_of_joins(spark, tmp_path):
    """Row counts and histograms show that the last join leaves few rows; then it comes first."""
    names = ["stats_big", "stats_wide", "stats_narrow"]
    frames = [
        spark.range(4000).selectExpr("id", "id % 500 as k1", "id % 400 as k2"),
        spark.range(3000).selectExpr("id % 500 as k1", "concat('w', id) as w"),
        spark.range(400).selectExpr("id as k2", "if(id % 100 = 0, 'x', concat('y', id)) as flag"),
    ]
    for name, frame in zip(names, frames):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        frame.write.option("path", str(tmp_path / name)).format("parquet").saveAsTable(name)
    try:
        query = (
            "SELECT * FROM stats_big b JOIN stats_wide w ON b.k1 = w.k1 JOIN stats_narrow n ON b.k2 = n.k2 WHERE n.flag = 'x'"
        )

        def first_join():
            plan = spark.sql(query)._jdf.queryExecution().optimizedPlan()
            deepest = plan
            while deepest.children().size() and deepest.children().apply(0).toString().count("Join") > 0:
                deepest = deepest.children().apply(0)
            return "w#" in deepest.toString(), deepest.toString()

        before, _ = first_join()
        for name in names:
            tables.analyze(spark, name)
        after, plan = first_join()
        assert before and not after, plan
        shown = dict((r[0], r[1]) for r in spark.sql("DESCRIBE EXTENDED stats_narrow k2").collect())
        assert 380 < int(shown["distinct_count"]) < 420 and "num_of_bins" in str(shown)
    finally:
        for name in names:
            spark.sql(f"DROP TABLE {name}")
    assert spark.conf.get("spark.sql.statistics.histogram.enabled") == "false"


def test_files_are_listed_by_rounds(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(text, "cut", lambda df, name: written.append(name) or cut(df, name))
    want = {}
    for a in range(6):
        for b in range(5):
            folder = tmp_path / "root" / f"a{a}" / f"b {b}" / "ñ"
            os.makedirs(folder)
            for n in range(a + b):
                (folder / f"f{n}.sql").write_bytes(b"x" * n)
                want[f"a{a}/b {b}/ñ/f{n}.sql"] = n
    (tmp_path / "root" / "config.yml").write_text("1")
    (tmp_path / "root" / "empty").mkdir()
    want["config.yml"] = 1
    got = text.folder_inventory(spark, str(tmp_path / "root"))
    assert {r.relative_path: r.size_bytes for r in got.collect()} == want and got.count() == len(want)
    assert len(written) == 4
    assert text.folder_inventory(spark, f"file://{tmp_path}/root/").count() == len(want)
    assert text.folder_inventory(spark, str(tmp_path / "root" / "empty")).collect() == []
    kinds = {r.file_category for r in got.select(F.col("file_category")).distinct().collect()}
    assert kinds == {"config", "other"}


def test_bucketed_steps_are_joined_where_they_lie(spark):
    """Between the published steps of the portfolio there is no exchange."""
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no data folder")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        joined = bucketed_portfolio(Lab(spark, folder))
        plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    plain = Published(Lab(spark, folder)).build().assembled()
    assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()


def test_texts_are_written_and_read_by_the_executors(spark, tmp_path):
    """One file for each name wherever its rows are; read back with what Spark's own reader gives."""
    rows = [(f"s={n % 50}/ñ {n % 50}.sql", f"é{n % 50}\n") for n in range(100)] + [("s=x/null.sql", None), ("s=y/.h.sql", "h")]
    files = spark.createDataFrame(rows, "file string, text string").repartition(7)
    for _ in range(2):
        assert text.write_texts(files, str(tmp_path / "t")) == 52
    names = {os.path.relpath(os.path.join(at, name), tmp_path / "t") for at, _, found in os.walk(tmp_path / "t") for name in found}
    assert names == {file for file, _ in rows}
    assert (tmp_path / "t" / "s=7" / "ñ 7.sql").read_text() == "é7\n\né7\n\n"
    plain = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").text(str(tmp_path / "t"), wholetext=True)
    want = plain.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    got = text.read_scripts(spark, str(tmp_path / "t"))
    assert got.inputFiles() != want.inputFiles()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 51


def test_a_task_lists_many_folders_in_one_batch(tmp_path):
    for n in range(300):
        (tmp_path / f"f{n}").mkdir()
        (tmp_path / f"f{n}" / "a.txt").write_text("a")
    folders = pa.RecordBatch.from_pydict({"path": [str(tmp_path / f"f{n}") for n in range(300)]})
    found = list(text._listed(str(tmp_path))(iter([folders])))
    assert len(found) == 1 and found[0].num_rows == 300


def test_tables_are_written_tightly(spark, tmp_path):
    """Results and intermediate tables take less room than by the codec a session comes with."""
    session = spark.newSession()
    session.conf.set("spark.sql.parquet.compression.codec", "snappy")
    rows = session.range(50_000).selectExpr("to_json(struct(id, concat('run-', id % 977) AS run, id * 7919 AS pos)) AS body")
    rows.repartition(1).write.parquet(str(tmp_path / "before"))
    apply_settings(session)
    rows.repartition(1).write.parquet(str(tmp_path / "after"))
    sizes = [sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet")) for name in ("before", "after")]
    assert sizes[1] < 0.8 * sizes[0]
