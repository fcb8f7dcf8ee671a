"""A durable queue of addresses to fetch: what was asked for and committed is never asked for again, whenever a run dies.

Addresses wait as files, some of them in each. A stream takes one file after the other, whose outcomes
land before they are read and are committed to the store together with the number of the batch. A batch
that is delivered again, since the run died before the stream noted it, is passed over if it was
committed, and read from where it landed if it was fetched.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.text import host_of
from daybook.operators.store import Store, Transaction
from daybook.sources.fetch import OUTCOME, fetch_all


def enqueue(store: Store, name: str, urls: DataFrame, batch: int = 1000) -> int:
    """Puts distinct addresses into the queue, about ``batch`` in a file, those of a host beside each other; returns how many."""
    wanted = urls.select("url").where("url is not null").distinct().withColumn("host", host_of(F.col("url")))
    n = wanted.count()
    if n:
        dealt = wanted.repartitionByRange(max(1, -(-n // batch)), "host", "url").drop("host")
        dealt.write.option("maxRecordsPerFile", batch).parquet(f"{store.root}/queue/{name}/files/{uuid.uuid4().hex}")
    return n


def run(store: Store, name: str, get: Callable[[str], tuple[int, bytes]], out: str, now: str, handle: Callable[[Transaction, DataFrame], None], **pace) -> int:
    """Works off what is in the queue; ``handle`` puts outcomes into a transaction. Returns the batches that were committed in this run."""
    from daybook.operators.localize import outcomes

    root, key, done = f"{store.root}/queue/{name}", f"queue.{name}", []
    fs, where = store.log.fs(f"{root}/files")
    if not fs.exists(where):
        return 0

    def step(rows: DataFrame, number: int) -> None:
        if int(store.get_state(key) or -1) >= number:
            return
        landed = f"{root}/landed/{number}"
        fs, mark = store.log.fs(f"{landed}/_SUCCESS")
        if not fs.exists(mark):
            fetch_all(rows, get, **pace).write.mode("overwrite").parquet(landed)
        results = outcomes(store.spark.read.schema(OUTCOME).parquet(landed), out, now)

        def change(tx: Transaction) -> None:
            handle(tx, results)
            tx.set_state(key, str(number))

        store.transact(change)
        done.append(number)

    stream = store.spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(f"{root}/files/*")
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return len(done)


def drain(store: Store, name: str, urls: Callable[[], DataFrame], get, out: str, now: str, handle: Callable[[Transaction, DataFrame], None], batch: int = 1000, **pace) -> int:
    """What an earlier run left in the queue, then what ``urls`` finds still to do; returns the batches committed."""
    before = run(store, name, get, out, now, handle, **pace)
    return before + (run(store, name, get, out, now, handle, **pace) if enqueue(store, name, urls(), batch) else 0)
