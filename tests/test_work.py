"""The queue of addresses: runs that die, batches that come again."""

import struct

import pytest

from daybook.operators.localize import record
from daybook.operators.store import Store
from daybook.schemas import TABLES
from daybook.streaming import work

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 4, 5)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    refs = [(i, None, f"http://h{i % 3}.invalid/{i // 2}", f"h{i % 3}.invalid", "entry", i, None, None, None, None) for i in range(60)]
    s.write("asset_refs", spark.createDataFrame(refs, TABLES["asset_refs"][0]))
    return s


def pending(store):
    return store.read("asset_refs").where("fetched_at is null").selectExpr("source_url AS url")


def fetcher(tmp_path):
    """Notes every request in a file, from whichever process."""
    log = tmp_path / "asked"

    def get(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        return (404, b"") if url.endswith("/7") else (200, PNG)

    return get, lambda: log.read_text().split() if log.exists() else []


def test_a_killed_run_repeats_nothing_that_was_committed(spark, store, tmp_path):
    get, asked = fetcher(tmp_path)
    all_urls = {r.url for r in pending(store).collect()}

    class Killed(Exception):
        pass

    seen = []

    def dies(tx, results):
        seen.append(1)
        if len(seen) == 3:
            raise Killed
        record(tx, results)

    with pytest.raises(Exception, match="Killed"):
        work.drain(store, "images", lambda: pending(store), get, str(tmp_path / "out"), "t1", dies, batch=8, delay=0.0)
    committed = {r.source_url for r in store.read("asset_refs").where("fetched_at is not null").collect()}
    first = asked()
    assert 0 < len(committed) < len(all_urls) and int(store.get_state("queue.images")) == 1
    batches = work.drain(store, "images", lambda: pending(store), get, str(tmp_path / "out"), "t2", record, batch=8, delay=0.0)
    assert batches >= 2 and pending(store).count() == 0
    assert sorted(asked()) == sorted(all_urls)  # each once, those of the batch that had landed included
    assert set(first) >= committed
    got = store.read("asset_refs")
    assert got.where("hash is null").count() == got.where("source_url like '%/7'").count() and store.read("assets").count() == 1
    assert work.drain(store, "images", lambda: pending(store), lambda u: 1 / 0, str(tmp_path / "out"), "t3", record) == 0


def test_a_batch_that_comes_again_is_passed_over(spark, store, tmp_path, monkeypatch):
    """The run dies after the store's commit and before the stream's."""
    get, asked = fetcher(tmp_path)
    work.enqueue(store, "images", pending(store), batch=1000)
    real = store.transact
    monkeypatch.setattr(store, "transact", lambda change: (real(change), 1 / 0))
    with pytest.raises(Exception, match="ZeroDivision"):
        work.run(store, "images", get, str(tmp_path / "out"), "t1", record, delay=0.0)
    monkeypatch.undo()
    n = len(asked())
    assert pending(store).count() == 0 and n == len(set(asked()))
    assert work.run(store, "images", get, str(tmp_path / "out"), "t2", record, delay=0.0) == 0 and len(asked()) == n
    assert store.read("asset_refs").where("fetched_at = 't2'").count() == 0


def test_an_empty_queue(spark, store, tmp_path):
    assert work.run(store, "none", None, str(tmp_path), "t", record) == 0
    assert work.enqueue(store, "none", pending(store).limit(0)) == 0
