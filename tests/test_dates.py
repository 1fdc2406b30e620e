import datetime as dt

import pytest
from pyspark.sql import functions as F

from logscope.functions.dates import date_bound, parse_relative_date, resolve_date

A = dt.datetime(2024, 1, 30, 23, 57, 0)
ACCEPTED = {
    "today": dt.datetime(2024, 1, 30), "TODAY": dt.datetime(2024, 1, 30), "ToDay": dt.datetime(2024, 1, 30),
    "yesterday": dt.datetime(2024, 1, 29), "last week": A - dt.timedelta(days=7),
    "last month": A - dt.timedelta(days=30), "last year": A - dt.timedelta(days=365),
    "7 days ago": A - dt.timedelta(days=7), "2 weeks ago": A - dt.timedelta(days=14),
    "1 day ago": A - dt.timedelta(days=1), "1 days ago": A - dt.timedelta(days=1),
    "10 day ago": A - dt.timedelta(days=10), "  7   days   ago  ": A - dt.timedelta(days=7),
    "3 months ago": A - dt.timedelta(days=90), "1 year ago": A - dt.timedelta(days=365),
}
REJECTED = ["7 days", "abc days ago", "-5 days ago", "", "tomorrow", "invalid date", "0 days ago", " today ",
            "99999999999999999999 days ago"]


def test_column_expression(spark):
    phrases = list(ACCEPTED) + REJECTED
    df = spark.createDataFrame([(p,) for p in phrases], "p string")
    got = dict(df.select("p", resolve_date(F.col("p"), F.lit(A).cast("timestamp_ntz")).alias("d")).collect())
    assert {p: got[p] for p in ACCEPTED} == ACCEPTED
    assert all(got[p] is None for p in REJECTED)


@pytest.mark.parametrize("p", list(ACCEPTED))
def test_driver_accepts(p):
    assert parse_relative_date(p, A) == ACCEPTED[p]


@pytest.mark.parametrize("p", REJECTED)
def test_driver_rejects(p):
    with pytest.raises(ValueError):
        parse_relative_date(p, A)


def test_absolute_bounds():
    assert date_bound("2024-01-05", A) == dt.datetime(2024, 1, 5)
    assert date_bound("2024-01-05", A, end=True) == dt.datetime(2024, 1, 5, 23, 59, 59, 999999)
