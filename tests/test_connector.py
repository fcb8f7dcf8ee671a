"""The server as a source: against a server in memory that logs what it was asked."""

import pytest
from daybook.operators.store import Store
from daybook.sources import connector
from daybook.sources.connector import older
from daybook.sources.sync import put_entries


def entry(i, when):
    return {"itemid": i, "anum": 0, "ditemid": i * 256, "eventtime": when, "body": f"b{i}", "security": "public", "props": {"k": "v"}, "taglist": "a, b"}


def journal(moments, cap=10**9):
    """A server of entries at the given times; it never gives more than ``cap``."""
    rows = [entry(i, t) for i, t in enumerate(moments)]

    def fetch(before, many):
        return sorted((r for r in rows if before is None or r["eventtime"] <= before), key=lambda r: r["eventtime"], reverse=True)[: min(many, cap)]

    return fetch


def walked(fetch, size):
    at, seen = {"before": None, "partial": []}, set()
    for _ in range(1000):
        page, at = older(fetch, at, size)
        if not page:
            return seen, at["partial"]
        seen |= {p["itemid"] for p in page}
    raise AssertionError("doesn't end")


DAY = "2004-05-0{} 10:00:00"
CROWD = [DAY.format(1)] * 3 + [DAY.format(2)] * 23 + [DAY.format(3)] * 4


@pytest.mark.parametrize("moments", [[], [DAY.format(1)], CROWD, [DAY.format(d) for d in range(1, 9)] * 2, [DAY.format(5)] * 64])
@pytest.mark.parametrize("size", [1, 4, 5, 50])
def test_every_entry_is_met(moments, size):
    seen, partial = walked(journal(moments), size)
    assert seen == set(range(len(moments))) and set(partial) <= {min(moments)} if moments else not seen | set(partial)


def test_a_server_of_small_pages_names_what_may_lack(size=5):
    seen, partial = walked(journal(CROWD, cap=7), size)
    assert partial == [DAY.format(2)] and {i for i, t in enumerate(CROWD) if t != DAY.format(2)} <= seen


def logged(fetch, log, fail_at=None):
    def ask(before, many):
        with open(log, "a") as f:
            f.write(f"{before}|{many}\n")
        if fail_at and before == fail_at[0] and not __import__("os").path.exists(fail_at[1]):
            raise OSError("down")
        return fetch(before, many)

    return ask


def exported(n, size, gone=()):
    """A server of comments 1 to n, ``size`` a page."""

    def export(kind, start):
        ids = [i for i in range(max(1, start), n + 1) if i not in gone][:size]
        rows = "".join(f'<comment id="{i}" jitemid="{i % 7}" posterid="{i % 3}"{"" if i % 5 else chr(32) + "state=" + chr(34) + "D" + chr(34)}><body> b{i} &lt;</body><date>d</date></comment>' for i in ids)
        return f"<livejournal><maxid>{n}</maxid><comments>{rows}</comments></livejournal>"

    return export


def test_entries_as_a_table(spark):
    connector.register(spark, journal(CROWD), exported(0, 1))
    got = spark.read.format("journal_entries").option("size", 5).load()
    assert sorted({r.itemid for r in got.collect()}) == list(range(len(CROWD)))
    first = got.where("itemid = 0").first()
    assert first.body == "b0" and first.props == {"k": "v"} and first.subject is None


def test_a_stream_of_entries_goes_on_where_it_stopped(spark, tmp_path):
    moments = [f"2004-05-{d:02} 10:00:00" for d in range(1, 21)]
    log, up = f"{tmp_path}/log", f"{tmp_path}/up"
    connector.register(spark, logged(journal(moments), log, (moments[10], up)), exported(0, 1))
    store = Store(spark, f"file://{tmp_path}/store")

    def run():
        stream = spark.readStream.format("journal_entries").option("size", 4).load()
        q = stream.writeStream.foreachBatch(lambda b, _: put_entries(store, b) and None).option("checkpointLocation", f"{tmp_path}/check").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="down"):
        run()
    half = store.read("entries").count()
    assert 0 < half < 20
    asked = open(log).read().splitlines()
    open(up, "w").close()
    run()
    assert sorted(r.itemid for r in store.read("entries").collect()) == list(range(20)) and store.read("entry_tags").count() == 40
    again = open(log).read().splitlines()[len(asked) :]
    assert "None|4" not in again and again[0] >= f"{moments[10]}|4"


@pytest.mark.parametrize("parallel", [1, 3, 100])
def test_comments_by_ranges_of_ids(spark, parallel):
    connector.register(spark, journal([]), exported(60, 7, gone={1, 13, 20, 21, 22, 60}))
    pages = spark.read.format("journal_comments").option("parallel", parallel).load()
    got = connector.comments_of(pages).orderBy("id").collect()
    assert [r.id for r in got] == [i for i in range(1, 61) if i not in {1, 13, 20, 21, 22, 60}]
    by = {r.id: r for r in got}
    assert by[4].body == " b4 <" and by[4].state == "A" and by[5].state == "D" and by[3].posterid is None and by[4].parentid is None


def test_no_comments(spark):
    connector.register(spark, journal([]), exported(0, 1))
    assert connector.comments_of(spark.read.format("journal_comments").load()).count() == 0
    assert spark.read.format("journal_entries").load().count() == 0


def test_a_stream_of_comments_takes_up_new_ids(spark, tmp_path):
    counts = []
    for n in (10, 10, 25):
        connector.register(spark, journal([]), exported(n, 4))
        stream = connector.comments_of(spark.readStream.format("journal_comments").option("parallel", 2).load())
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        q.processAllAvailable()
        q.stop()
        counts.append(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").count())
    assert counts == [10, 10, 25]
