from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import columns as c
from ledgerloom.functions import naming


def values(df):
    return [row[0] for row in df.collect()]


def test_balance_bands_are_upper_inclusive(spark):
    amounts = ["0", "-3", "0.01", "1", "1.01", "50", "500000", "500000.01", None]
    df = spark.createDataFrame([(a and Decimal(a),) for a in amounts], "v decimal(32,2)")
    assert values(df.select(c.balance_band(F.col("v")))) == [
        "(00) Sin saldo",
        "(00) Sin saldo",
        "(01) menor a 1",
        "(01) menor a 1",
        "(02) 1 a 50",
        "(02) 1 a 50",
        "(20) 450k - 500k",
        "(21) + 500k",
        "(00) Sin saldo",
    ]


def test_iso_week_code_matches_the_calendar(spark):
    days = [date(2024, 12, 30), date(2023, 1, 1), date(2021, 1, 3)]
    days += [date(1995, 1, 1) + timedelta(days=17 * n) for n in range(400)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    want = [d.isocalendar()[0] * 100 + d.isocalendar()[1] for d in days]
    assert values(df.select(c.iso_week_code(F.col("d")))) == want


def test_holder_role_falls_back_to_code_and_sequence(spark):
    df = spark.createDataFrame([("T ", "1"), ("Q", "7"), (None, "1")], "k string, s string")
    assert values(df.select(c.holder_role(F.col("k"), F.col("s")))) == ["T-TITULAR", "Q7", None]


def test_epoch_milliseconds_round_to_the_second(spark):
    df = spark.createDataFrame([(999,), (1499,), (1500,)], "v bigint")
    start = datetime(1970, 1, 1)
    assert values(df.select(c.epoch_ms(F.col("v")))) == [start + timedelta(seconds=s) for s in (1, 1, 2)]


def test_decoder_returns_error_text_and_keeps_null(spark):
    decoder = c.aes_decoder("0123456789abcdef")
    df = spark.createDataFrame([("abc",)], "v string").select(
        F.explode(F.array(c.aes_encode(F.col("v"), "0123456789abcdef"), F.lit("??"), F.lit(None))).alias("v")
    )
    assert values(df.select(decoder(F.col("v"), "t", "c", "malo"))) == ["abc", "malo", None]


def test_day_number_rejects_impossible_days(spark):
    df = spark.createDataFrame([(" 20010730 ",), ("20010732",), ("x",)], "v string")
    assert values(df.select(c.day_number(F.col("v")))) == [date(2001, 7, 30), None, None]


def test_codes_and_names(spark):
    one = spark.range(1)

    def value(col):
        return one.select(col).first()[0]

    assert value(c.rebuilt_product(F.lit("PF22"))) == "PF-0022"
    assert value(c.padded_branch(F.lit("17"))) == "0017"
    assert value(c.padded_branch(F.lit("000017"))) == "000017"
    assert value(c.dash_id(F.lit(None), F.lit(None))) is None
    assert value(c.dash_id(F.lit(1), F.lit(None), missing="0")) == "1-0"
    assert value(c.pct_change(F.lit(Decimal("3.00")), F.lit(Decimal("0.00")))) is None
    assert value(naming.ascii_slug(F.lit(" Ñandú_Uno--2 "))) == "and-uno-2"
    assert value(naming.unicode_slug(F.lit(" Ñandú_Uno--2 "))) == "ñandú-uno-2"
    assert value(naming.unicode_slug(F.lit("--"))) == "data_product"
    assert value(naming.business_name(F.lit("id_cliente2x"))) == "Id Cliente2X"
    assert value(F.struct(*naming.split_first_dot(F.lit("a.b.c")))) == ("a", "b.c")
    assert value(F.struct(*naming.split_last_dot(F.lit("a.b.c")))) == ("a.b", "c")
    assert value(F.struct(*naming.split_last_dot(F.lit("solo")))) == ("default", "solo")
    assert value(naming.contract_file_name(F.lit("demo.cuentas vivas"))) == "demo.cuentas_vivas.odcs.yaml"


def test_type_maps_and_inference(spark):
    kinds = {
        "INTEGER": "integer",
        "HUGEINT": "integer",
        "INTERVAL": "integer",
        "REAL": "number",
        "DECIMAL(32,2)": "number",
        "BOOLEAN": "boolean",
        "DATE": "date",
        "DATETIME": "timestamp",
        "": "string",
    }
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    assert values(df.select(naming.tabular_type(F.col("k")))) == list(kinds.values())
    names = {"fec_alta": "date", "hora": "timestamp", "es_nuevo": "boolean", "saldo": "number", "nombre": "string"}
    df = spark.createDataFrame([(n, []) for n in names], "n string, f array<string>")
    assert values(df.select(naming.inferred_type(F.col("n"), F.col("f")))) == list(names.values())
