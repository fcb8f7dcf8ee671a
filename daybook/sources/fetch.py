"""Fetching images: hosts are dealt to tasks whole, so that each host is asked by one task, one request after another."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.text import host_of

OUTCOME = "url string, http_status int, error string, content binary, hash string"


def fetch_one(url: str, get: Callable[[str], tuple[int, bytes]], sleep: Callable[[float], None], retries: int = 2) -> tuple:
    """Never raises: (status, error, content). Network errors and 5xx are tried again after 0.5, 1, ... seconds; addresses that are not http or https are not asked for."""
    if not re.match(r"https?://", url, re.I):
        return None, "not an address of the web", None
    status, error, content = None, None, None
    for attempt in range(retries + 1):
        try:
            status, content = get(url)
            error = None if status is not None else "no status"
        except Exception as e:  # noqa: BLE001 - one address must not end the stage, whatever its server sends
            status, error, content = None, str(e) or type(e).__name__, None
        if error is None and status < 500 or attempt == retries:
            break
        sleep(0.5 * 2**attempt)
    return status, error, content


def fetch_all(urls: DataFrame, get: Callable[[str], tuple[int, bytes]], delay: float = 0.25, concurrency: int = 8, sleep: Callable[[float], None] = time.sleep, held: int = 4 << 20) -> DataFrame:
    """url -> outcomes. Distinct addresses only; hosts run beside each other in ``concurrency`` tasks, which hold about ``held`` bytes at a time."""
    work = urls.select("url").where("url is not null").distinct().withColumn("host", host_of(F.col("url")))

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["url", "http_status", "error", "content", "hash"]).astype({"http_status": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, rows, size = None, [], 0
        for b in batches:
            for url, host in zip(b["url"], b["host"]):
                if host == last:
                    sleep(delay)
                last = host
                status, error, content = fetch_one(url, get, sleep)
                rows.append((url, status, error, content, hashlib.sha256(content).hexdigest() if content else None))
                size += len(content or b"")
                if size >= held:
                    yield frame(rows)
                    rows, size = [], 0
        if rows:
            yield frame(rows)

    return work.repartition(concurrency, "host").sortWithinPartitions("host", "url").mapInPandas(run, OUTCOME)


def recorded(urls: DataFrame, responses: DataFrame) -> DataFrame:
    """The same from recorded responses (url, http_status, content): what was not recorded is a network error."""
    met = urls.select("url").distinct().join(responses, "url", "left")
    error = F.when(F.col("http_status").isNull(), F.lit("not recorded"))
    return met.select("url", "http_status", error.alias("error"), "content", F.sha2("content", 256).alias("hash"))
