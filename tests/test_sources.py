import http.client
import struct

import pytest
from pyspark.sql import functions as F

from daybook import cli
from daybook.functions import media
from daybook.sources import fetch, paging, xmlrpc


def test_values_and_faults():
    xml = xmlrpc.encode_request("m", {"a": 1, "b": "x<&", "c": True, "d": ["p", 2], "e": None})
    body = xml[xml.index("<params>") :].replace("</methodCall>", "")
    assert xmlrpc.decode_response(f"<methodResponse>{body}</methodResponse>") == {"a": 1, "b": "x<&", "c": True, "d": ["p", 2]}
    bad = "<methodResponse><fault><value><struct><member><name>faultCode</name><value><int>101</int></value></member><member><name>faultString</name><value>no</value></member></struct></value></fault></methodResponse>"
    with pytest.raises(xmlrpc.Fault, match="101: no"):
        xmlrpc.decode_response(bad)


def test_backwards_ends_on_a_repeated_page():
    served = [{"eventtime": f"2004-01-{d:02}", "itemid": d} for d in range(1, 8)]
    kept, state = {}, {}

    def page(before):
        rows = [r for r in served if before is None or r["eventtime"] <= before]
        return sorted(rows, key=lambda r: r["eventtime"], reverse=True)[:3]

    def commit(rows):
        new = [r for r in rows if r["itemid"] not in kept]
        kept.update((r["itemid"], r) for r in rows)
        return len(new)

    assert paging.backwards(page, commit, state) == 7 and len(kept) == 7
    assert paging.backwards(page, commit, state) == 0


def test_client_policy():
    slept, replies = [], [(200, "a"), (500, ""), (503, ""), (200, "b"), (404, ""), (403, "")]
    c = paging.Client(lambda _: replies.pop(0), slept.append)
    assert c.request("x") == "a" and c.request("x") == "b"
    assert slept == [2.0, 1.0, 2.0]
    with pytest.raises(RuntimeError):
        c.request("x")
    with pytest.raises(paging.Banned):
        c.request("x")


def test_fetch_one_retries_and_never_raises():
    slept, replies = [], [(503, b""), (200, b"ok")]
    assert fetch.fetch_one("http://u", lambda _: replies.pop(0), slept.append) == (200, None, b"ok")
    assert slept == [0.5]

    def down(_):
        raise OSError("dns")

    assert fetch.fetch_one("http://u", down, slept.append) == (None, "dns", None)


def test_fetch_all_paces_hosts(spark):
    urls = spark.createDataFrame([(f"http://h{i % 2}.invalid/{i // 2}",) for i in range(8)] * 2, "url string")
    got = fetch.fetch_all(urls, lambda u: (200, u.encode()), delay=0.0, concurrency=3)
    assert got.count() == 8 and got.where("http_status = 200 and hash is not null").count() == 8


def test_login_parents():
    xml = xmlrpc.encode_request("m", {"username": "a", "fullname": "", "usejournals": ["x"]})
    body = xml[xml.index("<params>") :].replace("</methodCall>", "")
    assert xmlrpc.login_of(f"<methodResponse>{body}</methodResponse>") == {"username": "a", "fullname": None, "usejournals": ["x"], "moods": []}


def served(rows, known, most=None):
    """A server of entries, newest first, with pages of three unless more are asked for, up to ``most``; and a store."""

    def page(before, n=3):
        left = [r for r in rows if before is None or r["eventtime"] <= before]
        return sorted(left, key=lambda r: (r["eventtime"], r["itemid"]), reverse=True)[: min(n, most or n)]

    def commit(page):
        new = {r["itemid"] for r in page} - set(known)
        known.update((i, True) for i in new)
        return len(new)

    return page, commit


@pytest.mark.parametrize("same", [2, 3, 4, 5, 17])
@pytest.mark.parametrize("older", [0, 1, 3])
def test_backwards_passes_a_second_of_more_entries_than_a_page(same, older):
    rows = [{"eventtime": "2004-01-02 03:04:05", "itemid": 100 + i} for i in range(same)] + [{"eventtime": f"2003-01-02 03:04:{i:02}", "itemid": i} for i in range(older)]
    known, state = {}, {}
    assert paging.backwards(*served(rows, known), state) == len(rows) == len(known)
    assert paging.backwards(*served(rows, known), state) == 0


def test_backwards_goes_on_where_the_server_gives_no_larger_pages():
    rows = [{"eventtime": "2004-01-01 00:00:00", "itemid": 100 + i} for i in range(5)] + [{"eventtime": f"2003-01-02 03:04:{i:02}", "itemid": i} for i in range(4)]
    known, state = {}, {}
    assert paging.backwards(*served(rows, known, most=3), state) == 7
    assert state["entries.partial"] == ["2004-01-01 00:00:00"] and set(known) >= {0, 1, 2, 3}


@pytest.mark.parametrize("xml", ["<html>busy</html>", "<br", "", "<methodResponse/>", "<methodResponse><params/></methodResponse>"])
def test_what_is_no_response_raises(xml):
    with pytest.raises(xmlrpc.NoResponse):
        xmlrpc.events_of(xml)


@pytest.mark.parametrize("error", [http.client.IncompleteRead(b"x"), http.client.InvalidURL("bad"), ValueError("odd"), UnicodeError("label"), TimeoutError(), RuntimeError("any")])
def test_no_server_ends_the_stage(error):
    def bad(_):
        raise error

    status, told, content = fetch.fetch_one("http://a.invalid/", bad, lambda s: None)
    assert (status, content) == (None, None) and told


@pytest.mark.parametrize("url", ["file:///etc/hostname", "/etc/hostname", "ftp://a.invalid/x", "javascript:x()", ""])
def test_only_the_web_is_asked(url):
    assert fetch.fetch_one(url, lambda u: 1 / 0, lambda s: None)[1] == "not an address of the web"
    with pytest.raises(OSError):
        cli.get(url)


def test_a_task_holds_a_few_contents_at_a_time(spark):
    urls = spark.createDataFrame([(f"http://h.invalid/{i}",) for i in range(40)], "url string")
    got = fetch.fetch_all(urls, lambda u: (200, u.encode() * 1000), delay=0.0, concurrency=1, held=50_000)
    assert got.count() == 40 and got.select("hash").distinct().count() == 40


def test_backwards_takes_an_empty_larger_page_for_none():
    """The server gives a page of three of one second, and nothing where more are asked for."""
    rows = [{"eventtime": "2004-01-01 00:00:00", "itemid": 100 + i} for i in range(5)] + [{"eventtime": "2003-01-02 03:04:05", "itemid": 1}]
    known, state = {}, {}
    page, commit = served(rows, known)
    assert paging.backwards(lambda before, n=3: page(before, n) if n == 3 else [], commit, state) == 4
    assert state["entries.partial"] == ["2004-01-01 00:00:00"] and 1 in known


def test_ranges_of_a_table(spark):
    """Pages of about the size asked for, each id on one page, a cursor to go on from; nulls on none."""
    rows = spark.range(5000).selectExpr("id * 3 AS id").union(spark.range(50).selectExpr("7 AS id")).union(spark.createDataFrame([(None,)], "id long")).repartition(5)
    pages, state = [], {}
    n = paging.by_key(rows, lambda page, k: pages.append((k, [r[0] for r in page.collect()])), state, "t", 400)
    assert n == len(pages) == 13 and [k for k, _ in pages] == list(range(13)) and max(len(p) for _, p in pages) < 600
    assert sorted(i for _, p in pages for i in p) == sorted([*range(0, 15_000, 3), *[7] * 50])
    assert all(max(a) < min(b) for (_, a), (_, b) in zip(pages, pages[1:]))
    assert paging.by_key(rows, lambda *_: 1 / 0, state, "t", 400) == n
    assert paging.by_key(rows.union(spark.range(20_000, 20_003)), lambda page, k: pages.append((k, [r[0] for r in page.collect()])), state, "t", 400) == n + 1
    assert sorted(pages[-1][1]) == [20_000, 20_001, 20_002]
    assert paging.by_key(rows.limit(0), lambda *_: 1 / 0, {}, "t", 10) == 0


def test_sizes_of_odd_files(spark):
    bmp = b"BM" + bytes(16) + struct.pack("<ii", 640, -480) + bytes(10)
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 1 << 31, 5)
    jpeg = bytes.fromhex("FFD8FFE000040000") + b"\x17\x00" + bytes.fromhex("FFFFC0000B080258032003012200")
    df = spark.createDataFrame([(1, bmp), (2, png), (3, jpeg), (4, bmp[:20]), (5, None)], "id int, content binary")
    got = {r.id: r.s and tuple(r.s) for r in df.select("id", media.read_size(F.col("content")).alias("s")).collect()}
    assert got == {1: (640, 480), 2: None, 3: (800, 600), 4: None, 5: None}
