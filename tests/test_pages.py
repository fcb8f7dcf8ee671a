"""Pages of a whole table by ranges of its key."""

import os

import pytest
from daybook.plans import trees
from daybook.sources import paging
from pyspark.sql import functions as F

SF = os.environ.get("DAYBOOK_TEST_SF", "/root/testdata/sf0.001")


def test_whole_table_comes_back(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    want = sorted(r[0] for r in orders.collect())
    assert max(want) >= 200 and sorted(r[0] for r in trees.pages_stored(orders, 400).collect()) == want


def test_repeated_missing_and_no_ids(spark):
    rows = spark.createDataFrame([(i,) for i in [5, -3, 5, 5, None, 9, 1]], "id long")
    assert sorted(r[0] for r in trees.pages_stored(rows, 2).collect()) == [-3, 1, 5, 5, 5, 9]
    assert trees.pages_stored(rows.where("id is null"), 2).count() == 0


def test_a_failed_page_is_read_again(spark):
    rows, state, kept = spark.range(10), {}, {}

    def commit(page, k):
        if k == 1 and not kept.get("failed"):
            kept["failed"] = True
            raise OSError("disk")
        kept[k] = [r[0] for r in page.collect()]

    with pytest.raises(OSError):
        paging.by_key(rows, commit, state, "c", 4)
    assert state == {"c": 4, "c.pages": 1}
    assert paging.by_key(rows, commit, state, "c", 4) == 3
    assert sorted(kept[0] + kept[1] + kept[2]) == list(range(10))
