"""Paged sources with a checkpoint that is written after the page it covers."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.shared import shared_dir, swept


def moment_before(time: str) -> str:
    """One second earlier, or one day for a bare date."""
    step = timedelta(days=1) if len(time) == 10 else timedelta(seconds=1)
    return (datetime.fromisoformat(time) - step).isoformat(" ")[: len(time)]


def backwards(fetch: Callable[..., list[dict]], commit: Callable[[list[dict]], int], state: dict) -> int:
    """Entries from newest to oldest by 'before this date'; ends on an empty page.

    ``fetch(before)`` gives a page, ``fetch(before, n)`` one of up to n entries. ``commit`` stores a
    page and says how many rows were new. A page without new rows may lie within one moment of more
    entries than a page holds: it is asked for again, twice as large each time, until it brings new
    rows or is not full. Where the server won't give larger pages the walk goes on before that
    moment, which ``entries.partial`` of the state then names as one that may lack entries. Returns the rows stored.
    """
    total = 0
    while page := fetch(state.get("entries.before")):
        new, usual = commit(page), max(len(page), state.get("entries.page", 0))
        oldest = min(p["eventtime"] for p in page)
        asked = usual
        while not new and len(page) >= asked and oldest == state.get("entries.before"):
            asked *= 2
            page = fetch(oldest, asked)
            if page:
                new, oldest = commit(page), min(p["eventtime"] for p in page)
            if not new and len(page) <= usual:  # no larger page is to be had, none at all included
                state["entries.partial"] = [*state.get("entries.partial", []), oldest]
                break
        total += new
        stuck = not new and oldest == state.get("entries.before")
        state |= {"entries.before": moment_before(oldest) if stuck else oldest, "entries.page": usual}
    return total


def forwards(fetch: Callable[[int], tuple[list[dict], int]], commit: Callable[[list[dict]], int], state: dict, key: str) -> int:
    """Comments from id 0 upward: each page starts behind the highest id so far, up to the index's maximum."""
    total = 0
    while True:
        page, top = fetch(state.get(key, 0))
        if not page:
            return total
        total += commit(page)
        state[key] = max(p["id"] for p in page) + 1
        if state[key] > top:
            return total


def by_key(rows: DataFrame, commit: Callable[[DataFrame, int], None], state: dict, key: str, size: int) -> int:
    """A table by ranges of its whole-numbered ``id``, about ``size`` rows a page; the driver holds the ranges' ends alone.

    What is left is written once in the order of ids, so a page reads its own range and not the rest. Each page is committed, as
    a DataFrame with its number, before the cursor moves. Rows of one id share a page; rows without an id are on none. Returns the
    number of pages in all.
    """
    spark, start = rows.sparkSession, state.get(key)
    left = rows.where("id is not null") if start is None else rows.where(F.col("id") >= start)
    path = f"{shared_dir(spark)}/by-key-{uuid.uuid4().hex}"
    swept(spark, path)
    left.repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
    kept = spark.read.schema(left.schema).parquet(path)
    pages = -(-kept.count() // size)
    steps = [i / pages for i in range(1, pages)]
    ends = kept.agg(F.max("id").alias("last"), *([F.percentile_approx("id", steps, 20 * max(pages, 500)).alias("cuts")] if steps else [])).first()
    for end in sorted({*(ends["cuts"] if steps else []), ends["last"]} - {None}):
        begin, n = state.get(key), state.get(f"{key}.pages", 0)
        commit(kept.where(F.col("id") <= end) if begin is None else kept.where(F.col("id").between(begin, end)), n)
        state |= {key: end + 1, f"{key}.pages": n + 1}
    return state.get(f"{key}.pages", 0)


class Banned(Exception):
    """The server refuses all further requests."""


class Client:
    """Paced requests with retries: 403 is final for the run, other 4xx for the request, 5xx and network errors are tried again."""

    def __init__(self, send: Callable[[str], tuple[int, str]], sleep: Callable[[float], None] = time.sleep, spacing: float = 2.0, retries: int = 3):
        self.send, self.sleep, self.spacing, self.retries, self.sent = send, sleep, spacing, retries, 0

    def request(self, body: str) -> str:
        for attempt in range(self.retries + 1):
            if self.sent:
                self.sleep(self.spacing if not attempt else 2.0 ** (attempt - 1))
            self.sent += 1
            try:
                status, text = self.send(body)
            except OSError as e:
                status, text = 599, str(e)
            if status == 403:
                raise Banned("403")
            if status < 400:
                return text
            if status < 500:
                break
        raise RuntimeError(f"request failed with {status}")
