"""Gaps and next dates over the orders of all customers."""

import datetime
import os

import pytest
from daybook.plans import windows

SF = os.environ.get("DAYBOOK_TEST_SF", "/root/testdata/sf0.001")


def orders(spark, rows):
    return spark.createDataFrame([(c, d and datetime.date.fromisoformat(d)) for c, d in rows], "o_custkey long, o_orderdate date")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([], []),
        ([(1, "2004-02-28"), (200, "2004-02-28"), (1, None)], []),
        ([(1, "2004-02-01"), (500, "2004-02-11"), (1, "2004-02-16")], [("2004-02-01", "2004-02-11", 10)]),
        ([(1, "2004-03-03"), (150, "2004-03-01"), (1, "2004-02-28"), (1, "2004-03-05")], [("2004-02-28", "2004-03-01", 2)]),
        ([(1, "2003-12-31"), (None, "2004-01-02"), (100, "2004-01-03")], [("2003-12-31", "2004-01-02", 2)]),
    ],
)
def test_longest_gap(spark, rows, want):
    assert [tuple(r) for r in windows.gap_of(orders(spark, rows)).collect()] == want


@pytest.mark.parametrize(
    ("rows", "want"),
    [([], None), ([(1, "2004-12-24"), (50, "2003-12-27"), (1, "2004-12-30")], "12-27"), ([(70, "2004-12-24"), (80, "2004-03-01"), (1, None)], "03-01"), ([(1, "2004-12-26"), (99, "2001-12-25")], "12-25")],
)
def test_next_date(spark, rows, want):
    assert windows.next_of(orders(spark, rows)).first()[0] == want


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/orders.parquet")
    days = sorted({r[0] for r in table.select("o_orderdate").collect()})
    most, start = max(((b - a).days, -i) for i, (a, b) in enumerate(zip(days, days[1:])))
    got = windows.gap_of(table).first()
    assert (got["start"], got["days"]) == (str(days[-start])[:10], most)
