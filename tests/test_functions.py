from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import functions as table_functions
from tidemark.functions import textfn as tx, timefn as tm


def ts(text):
    return datetime.fromisoformat(text)


def pair(spark, a, b):
    return spark.createDataFrame([(ts(a), ts(b))], "a timestamp_ntz, b timestamp_ntz")


@pytest.mark.parametrize("unit,a,b,n", [
    ("minute", "2024-01-01 09:00:59", "2024-01-01 09:01:01", 1),
    ("hour", "2024-01-01 09:59:59", "2024-01-01 10:00:00", 1),
    ("second", "2024-01-01 09:00:00.9", "2024-01-01 09:00:01.1", 1),
    ("day", "2024-01-01 23:59:59", "2024-01-02 00:00:00", 1),
    ("month", "2024-01-31 00:00:00", "2024-02-01 00:00:00", 1),
    ("month", "2023-12-31 00:00:00", "2024-01-01 00:00:00", 1),
    ("minute", "2024-01-01 09:01:01", "2024-01-01 09:00:59", -1),
])
def test_boundary_diff(spark, unit, a, b, n):
    assert pair(spark, a, b).select(tm.boundary_diff(unit, "a", "b")).first()[0] == n


OPEN, CLOSE = 8.5 * 60, 23 * 60


@pytest.mark.parametrize("a,b,minutes", [
    ("2024-01-01 07:00:00", "2024-01-01 09:00:00", 30),          # opened before hours, same day
    ("2024-01-01 12:00:00", "2024-01-01 12:45:00", 45),          # inside hours
    ("2024-01-01 23:30:00", "2024-01-01 23:50:00", 20),          # after closing, same day counts
    ("2024-01-01 08:30:00", "2024-01-02 09:00:00", 870 + 30),    # at opening, next day
    ("2024-01-01 12:00:00", "2024-01-02 09:00:00", 660 + 30),    # inside hours, next day
    ("2024-01-01 23:00:00", "2024-01-02 09:00:00", 30),          # at closing, next day
    ("2024-01-01 23:30:00", "2024-01-04 09:00:00", 2 * 870 + 30),  # three days on
    ("2024-01-01 12:00:00", "2024-01-02 08:00:00", 660 - 30),    # ends before opening: not clamped
    ("2024-01-01 07:00:00", "2024-01-02 23:30:00", 870 + 900),   # ends after closing: not clamped
])
def test_office_minutes(spark, a, b, minutes):
    assert pair(spark, a, b).select(tm.office_minutes("a", "b")).first()[0] == minutes


def test_office_minutes_clamped(spark):
    df = pair(spark, "2024-01-01 12:00:00", "2024-01-02 08:00:00")
    assert df.select(tm.office_minutes("a", "b", clamp=True)).first()[0] == 660


def test_clock_and_month_helpers(spark):
    df = pair(spark, "2024-03-31 10:11:12.5", "2024-03-31 00:00:00")
    row = df.select(tm.time_of_day("a"), tm.at_time("a", "14:00:00"), tm.months_back("a", 1),
                    tm.local_ts("b", 330), tm.month_index("a")).first()
    assert row[0] == "10:11:12" and row[1] == ts("2024-03-31 14:00:00")
    assert str(row[2]) == "2024-02-01" and row[3] == ts("2024-03-31 05:30:00")
    assert row[4] == 2024 * 12 + 3


@pytest.mark.parametrize("code,want", [("", "000000"), ("7", "000007"), ("123456", "123456"),
                                       ("1234567", None), (None, None)])
def test_pad_code(spark, code, want):
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(tx.pad_code(F.col("c"))).first()[0] == want


@pytest.mark.parametrize("text,want", [
    ("M0001234", 1234), ("m #0001234", 1234), ("Order #0001234", 1234), ("0001234", 1234),
    ("none", None), ("m 0001234", 1234), (None, None)])
def test_order_id_from_comment(spark, text, want):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(tx.order_id_from_comment(F.col("c"))).first()[0] == want


def test_notes_and_delimited_ids(spark):
    df = spark.createDataFrame([("Hold: 12", "01-05 10:20 - Deleted", "77|x"),
                                ("plain", "Deleted", "x|77")], "n string, r string, d string")
    got = df.select(tx.note_action(F.col("n")), tx.note_time(F.col("r"), "Deleted", 2024),
                    tx.delimited_id(F.col("d"))).collect()
    assert tuple(got[0]) == ("Hold:", ts("2024-01-05 10:20:00"), 77)
    assert tuple(got[1]) == ("", None, None)


def test_operators_as_table_functions(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 7), (3, "a", 9)], "id int, kind string, v int")
    table_functions.publish(df, "big_rows", {"lo": "INT", "which": "STRING"}, "v >= lo AND (which IS NULL OR kind = which)")
    table_functions.set_variable(spark, "bound", "INT", 7)
    got = lambda text: sorted(r.id for r in spark.sql(text).collect())
    assert got("SELECT id FROM big_rows(bound, NULL)") == [2, 3]
    table_functions.set_variable(spark, "bound", "INT", 5)
    assert got("SELECT id FROM big_rows(bound, 'a')") == [1, 3]
    assert got("SELECT a.id FROM big_rows(9, NULL) a JOIN big_rows(5, 'a') b ON a.id = b.id") == [3]
    table_functions.publish(df.filter("id = 1"), "big_rows")  # replaced
    assert got("SELECT id FROM big_rows()") == [1]
    table_functions.set_variable(spark, "quoted", "STRING", "it's; DROP")
    assert spark.sql("SELECT quoted AS q").first().q == "it's; DROP"
    for bad in ("x y", "a;b", "1a"):
        with pytest.raises(ValueError):
            table_functions.publish(df, bad)
        with pytest.raises(ValueError):
            table_functions.set_variable(spark, bad, "INT", 1)
