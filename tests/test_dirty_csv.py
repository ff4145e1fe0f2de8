"""CSV files with NULs, line breaks in values, and rows that look like the header."""

import csv
import io

import pytest

from ledgerloom.sources import text

TEXTS = "clave string, nombre string, nota string"


def written(path, rows, header=("clave", "nombre", "nota"), end="\n", mark=""):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(header)
    writer.writerows(rows)
    path.write_bytes((mark + out.getvalue()).encode())


def read(spark, path, schema=TEXTS, **options):
    return [tuple(r)[1:] for r in text.read_dirty_csv(spark, str(path), schema, **options).orderBy("file", "line").collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_values_with_line_breaks_survive(spark, tmp_path, end):
    rows = [("1", "a\nb", 'say "hi"\n\n"x"'), ("clave", "nombre", "nota"), ("2", "c,d", "e"), ("3", '"', "\n"), ("4", "x", "y")]
    written(tmp_path / "a.csv", rows, end=end, mark="﻿")
    got = [row[1:4] for row in read(spark, tmp_path / "a.csv")]
    assert got == rows


def test_nul_characters_go(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'clave,nombre,nota\n1,"a\0\nb",\0c\n\0\n2,"d",e\n')
    assert [row[1:] for row in read(spark, tmp_path / "a.csv")] == [("1", "a\nb", "c", None), ("2", "d", "e", None)]


def test_unreadable_values_are_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,n,x\n1,2,a\nuno,2,b\n3,4\n5,6,c,d\n")
    got = read(spark, tmp_path / "a.csv", "k int, n int, x string")
    assert [(row[0], row[-1]) for row in got] == [(2, None), (3, "uno,2,b"), (4, "3,4"), (5, "5,6,c,d")]
    assert got[0][1:4] == (1, 2, "a") and got[1][1] is None


def test_records_over_slices_and_files(spark, tmp_path):
    """Many splits: records cross them, and the parity is carried over from one slice to the next."""
    many = {}
    for name in ("a", "b"):
        many[name] = [(f"{name}{i}", "\n".join(["x"] * (i % 5)), '"' * (i % 3)) for i in range(400)]
        written(tmp_path / f"{name}.csv", many[name])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = [tuple("" if v is None else v for v in row[1:4]) for row in read(spark, tmp_path)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == many["a"] + many["b"]


def test_an_unclosed_quote_makes_no_endless_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "RECORD_LINES", 5)
    (tmp_path / "a.csv").write_text('k,n,x\n1,2,a\n2,"open,b\n' + "3,4,c\n" * 20)
    got = read(spark, tmp_path / "a.csv", TEXTS)
    assert [row[0] for row in got] == [2, 3, *range(4, 24)] and got[5][1:] == ("3", "4", "c", None)


def test_without_header_and_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿1,a,b\n")
    assert read(spark, tmp_path / "a.csv", header=False) == [(1, "1", "a", "b", None)]
    (tmp_path / "b.csv").write_text("")
    assert read(spark, tmp_path / "b.csv") == []
