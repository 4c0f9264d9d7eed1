import hashlib
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import calendars, scalars
from ledgerloom.operators import mapping


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_headers(spark):
    assert apply(spark, scalars.normalize_header, ["Net Value ($)", "net_value", "NET-VALUE", "", None]) == ["netvalue"] * 3 + ["", None]
    cut = apply(spark, scalars.strip_noise, ["marketvalueusd", "usd", "qtyamt", "netlocalusd", "xyusd", "xyzusd", "valueinbase"])
    assert cut == ["marketvalue", "usd", "qty", "netlocal"[:3] if False else "net", "xyusd", "xyz", "valuein"]


def test_numbers(spark):
    cells = ["1,234.50", "(1,234.50)", "12-", "$ 5", "€7%", "", "-", "--", "n/a", "NULL", "abc", "-3", "(-3)", "1e3", " 8 ", None]
    got = [None if x is None else float(x) for x in apply(spark, scalars.to_decimal, cells)]
    assert got == [1234.5, -1234.5, -12, 5, 7, None, None, None, None, None, None, -3, 3, 1000, 8, None]


def test_dates(spark):
    cells = ["2026-08-28", "2026/8/28", "28/08/2026", "8/28/2026", "28-Aug-2026", "28AUG2026", "20260828", "28.08.2026", "2026-08-28 17:30", "2026-08-28T01:02:03Z", "1.1.1889", "99999999", "x", "", None, "03/04/2026"]
    d = date(2026, 8, 28)
    assert apply(spark, scalars.parse_date, cells) == [d] * 10 + [None] * 5 + [date(2026, 4, 3)]
    names = ["MCP_TRD_20260831.csv", "x-2026-08-31.txt", "pos_28Aug2026.xlsx", "a123456789.csv", "none.csv"]
    assert apply(spark, scalars.filename_date, names) == [date(2026, 8, 31)] * 2 + [d, None, None]


def test_small_ones(spark):
    assert apply(spark, scalars.mask_account, ["", "42", "0000", "00001", "123456789", "ACCT-Ω-7781", None]) == ["", "**", "****", "*0001", "*****6789", "*******7781", None]
    assert apply(spark, scalars.normalise_side, ["b", " Sold ", "SH", "other", " ", None]) == ["BUY", "SELL", "SHORT", "OTHER", None, None]
    assert apply(spark, scalars.sanitize_name, ["a/b", "..", "x y.csv"]) == ["a_b", "_", "x_y.csv"]
    assert apply(spark, scalars.escapes_root, ["a/../b", "..", "a..b", "../x", "x/.."]) == [True, True, False, True, True]
    assert apply(spark, scalars.clamp_confidence, ["0.9", "-1", "x", None, "0.5"]) == [0.85, 0.0, 0.7, 0.7, 0.5]
    assert apply(spark, scalars.readable, ["tradeDate_local", "netAmount"]) == ["trade date local", "net amount"]
    stamps = apply(spark, lambda c: scalars.rfc3339(F.to_timestamp(c)), ["2026-08-31 06:00:00", "2026-08-31 06:00:00.12"])
    assert stamps == ["2026-08-31T06:00:00Z", "2026-08-31T06:00:00.12Z"]
    row = spark.range(1).select(scalars.record_hash([F.lit("a"), F.lit(None), F.lit("b")]).alias("h"), scalars.slot_key(F.lit("c"), F.lit(None), F.lit("d")).alias("k")).first()
    assert row.h == hashlib.sha256(b"a\x1f\x1fb\x1f").hexdigest() and row.k == "c::d"


@settings(max_examples=40, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_indel_ratio(a, b):
    def lcs(x, y):
        return 0 if not x or not y else lcs(x[1:], y[1:]) + 1 if x[0] == y[0] else max(lcs(x[1:], y), lcs(x, y[1:]))

    assert mapping.indel_ratio(a, b) == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)


CLOSED = {"X": [("2026-08-31", "Bank day"), ("2026-01-01", "New Year")]}


def is_open(d):
    return d.weekday() < 5 and d.isoformat() not in {x for x, _ in CLOSED["X"]}


def step(d, n):
    way = 1 if n > 0 else -1
    for _ in range(abs(n)):
        d += timedelta(way)
        while not is_open(d):
            d += timedelta(way)
    return d


def test_business_days(spark):
    days = calendars.calendar_days(spark, CLOSED, "2025-12-01", "2026-12-31")
    dates = [date(2026, 8, 20) + timedelta(i) for i in range(20)]
    df = spark.createDataFrame([("X", d) for d in dates], "calendar_id string, d date")
    for n in (0, 1, 2, 5, -1, -2, -7):
        got = {r.d: r.o for r in calendars.add_business_days(df, days, "calendar_id", "d", n, "o").collect()}
        assert got == {d: step(d, n) for d in dates}, n
    got = {r.d: r.o for r in calendars.roll(df, days, "calendar_id", "d", "o").collect()}
    assert got == {d: d if is_open(d) else step(d, -1) for d in dates}

    def between(a, b):
        if a > b:
            return -between(b, a)
        n = 0
        while a < b:
            a, n = step(a, 1), n + 1
        return n

    end = date(2026, 8, 30)
    got = {r.d: r.o for r in calendars.business_days_between(df.withColumn("e", F.lit(end)), days, "calendar_id", "d", "e", "o").collect()}
    assert got == {d: between(d, end) for d in dates}
    assert days.where("day = '2026-08-31'").first().holiday == "Bank day"
