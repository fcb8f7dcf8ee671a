"""Sync, local images, harvest, audit, redaction of XML, progress, SQL and the library's surface."""

import base64
import struct

import pytest

import daybook
from daybook import cli
from daybook.functions import harvest, html, scrub, xml
from daybook.functions.xml import unescape
from daybook.operators import audit, localize, pictures
from daybook.operators.store import Store
from daybook.progress import Event, observed
from daybook.schemas import TABLES
from daybook.sources import files, paging, xmlrpc
from daybook.sources.sync import sync
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 4, 5)


def response(value: dict) -> str:
    body = xmlrpc.encode_request("m", value)
    return f"<methodResponse>{body[body.index('<params>') : body.index('</methodCall>')]}</methodResponse>"


def server(n: int):
    """Answers like a journal of n entries, one a day, the page limited to three."""

    def struct_of(i: int) -> str:
        members = {"itemid": i, "anum": 1, "eventtime": f"2004-01-{i:02} 10:00:00", "event": f'<img src="a{i % 2}.png"> day {i}', "security": "private"}
        out = xmlrpc.encode_request("m", members)
        return out[out.index("<value><struct>") : out.index("</param>")].replace("</struct>", "<member><name>props</name><value><struct><member><name>taglist</name><value>a, b</value></member></struct></value></member></struct>", 1)

    def send(body: str) -> tuple[int, str]:
        if "getchallenge" in body:
            return 200, response({"challenge": "c1"})
        if ".login" in body:
            assert xmlrpc.reply_to("c1", "d") in body
            return 200, "<methodResponse><params><param><value><struct><member><name>username</name><value>me_too</value></member><member><name>moods</name><value><array><data><value><struct><member><name>id</name><value><int>3</int></value></member><member><name>name</name><value>calm</value></member></struct></value></data></array></value></member></struct></value></param></params></methodResponse>"
        before = body.split("beforedate</name><value><string>")[1].split("<")[0] if "beforedate" in body else "9"
        rows = [i for i in range(n, 0, -1) if f"2004-01-{i:02} 10:00:00" < before][:3]
        return 200, "<methodResponse><params><param><value><struct><member><name>events</name><value><array><data>" + "".join(map(struct_of, rows)) + "</data></array></value></member></struct></value></param></params></methodResponse>"

    return send


EXPORT = {
    ("comment_meta", 0): "<j><comments><comment id='3' jitemid='1' posterid='7' state='A'/><comment id='5' jitemid='2' state='D'/></comments><usermaps><usermap id='7' user='some_one'/></usermaps></j>",
    ("comment_body", 0): "<j><comments><comment id='3' jitemid='1' posterid='7' state='A'><body>hi</body></comment></comments></j>",
    ("comment_body", 4): "<j><comments><comment id='5' jitemid='2' state='D'/></comments></j>",
}


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    store, told = Store(spark, f"file://{tmp_path_factory.mktemp('store')}"), []
    client = paging.Client(server(7), lambda s: None)
    n = sync(store, client, "me_too", "d", lambda kind, start: EXPORT.get((kind, start), "<j/>"), told.append)
    return store, told, n


def test_sync_reads_all_and_goes_on(archive):
    store, told, n = archive
    assert n == {"entries": 7, "comments": 2, "users": 1, "moods": 1}
    assert store.read("entry_tags").count() == 14
    assert [e.kind for e in told if e.task == "login"] == ["start", "done"] and any(e.kind == "tick" and e.task == "entries" for e in told)
    again = sync(store, paging.Client(server(7), lambda s: None), "me_too", "d")
    assert again["entries"] == 7 and store.read("entry_tags").count() == 14
    assert {r["state"] for r in store.read("comments").collect()} == {"A", "D"}


def test_images_userpics_posters(archive, spark, tmp_path):
    store = archive[0]

    def get(url):
        return (200, PNG) if url.endswith("a0.png") or "pic" in url else (404, b"")

    stats = localize.images(store, "https://me-too.invalid", get, str(tmp_path), "t1", delay=0.0)
    assert (stats["refs"], stats["urls"], stats["pending"], stats["dead"], stats["ok"]) == (7, 2, 0, 4, 1)
    again = localize.images(store, "https://me-too.invalid", lambda u: 1 / 0, str(tmp_path), "t2", delay=0.0)
    assert again["refs"] == 7 and store.read("asset_refs").where("fetched_at = 't2'").count() == 0
    pics = [(1, 9, "http://h.invalid/pic", None, None, None), (2, 9, "http://h.invalid/pic", None, None, None), (3, 9, "http://h.invalid/gone", None, None, None)]
    store.write("userpics", spark.createDataFrame(pics, TABLES["userpics"][0]))
    assert localize.userpics(store, get, str(tmp_path), "t3", delay=0.0) == {"known": 3, "stored": 2, "failed": 1}
    embeds = [(1, 0, "https://proxy.invalid/e?source=youtube&vid=abc", None, None), (1, 1, "https://other.invalid/x", None, None)]
    store.write("entry_embeds", spark.createDataFrame(embeds, TABLES["entry_embeds"][0]))
    assert localize.video_posters(store, get, str(tmp_path), "t4", delay=0.0) == {"known": 2, "stored": 0, "failed": 1}
    assert len(list(tmp_path.rglob("*.png"))) == 1


def test_command_line(spark, tmp_path, monkeypatch):
    where = ["--store", f"file://{tmp_path}/s", "--out", str(tmp_path / "site")]
    assert cli.main(["images", *where], spark) == 2 and cli.main(["fetch", *where], spark) == 2
    monkeypatch.setenv("DAYBOOK_MD5", "d")
    assert cli.main(["fetch", *where, "--user", "me_too", "--delay", "0"], spark, send=lambda b: (403, "")) == 3
    assert cli.main(["fetch", *where, "--user", "me_too", "--delay", "0"], spark, send=server(2)) == 0
    assert cli.main(["images", *where], spark, get=lambda u: (200, PNG)) == 0 and cli.main(["status", *where], spark) == 0


PAGE = """<div id="sidebar"><img class="x" src="https://l-userpic.livejournal.com/1/1"></div><iframe src="chrome"></iframe>
<div class="subcontent"><div class="userpicfriends"><img src="https://l-userpic.livejournal.com/11/7"></div></div>
<div class="entry_text">One<br>two &amp; three<br/><iframe src="https://v.invalid/1"></iframe><div class="ljtags">tags<br></div></div>
<div id="ljcmt771"><img class="userpiccomment" src="https://l-userpic.livejournal.com/12/8"><div id="ljcmt1283"><img class="userpiccomment" src="other.gif"></div></div>"""


def test_harvest_and_what_is_taken(spark):
    h = harvest.harvest(PAGE)
    assert h["entry"] == {"picid": 11, "userid": 7, "url": "https://l-userpic.livejournal.com/11/7"}
    assert h["comments"] == [{"comment_id": 3, "picid": 12, "userid": 8, "url": "https://l-userpic.livejournal.com/12/8"}]
    assert (h["frames"], h["breaks"], h["text"]) == (["https://v.invalid/1"], 2, "Onetwo & three")
    assert harvest.harvest(None)["text"] is None and harvest.harvest("<p>x")["breaks"] is None
    rows = spark.createDataFrame([(257, PAGE), (300, None), (301, "")], "ditemid bigint, html string")
    found = rows.select("ditemid", harvest.harvest_udf(F.col("html")).alias("h")).select("ditemid", "h.*")
    tables = {n: spark.createDataFrame([], TABLES[n][0]) for n in ("userpics", "entry_userpics", "comment_userpics", "entry_embeds", "comments")}
    tables["comments"] = spark.createDataFrame([(4, 1)], "id bigint, jitemid bigint")
    tables["userpics"] = spark.createDataFrame([(11, 7, "old", "k", "h", "t")], TABLES["userpics"][0])
    new = pictures.take_harvest(tables, found)
    assert {(r["picid"], r["url"]) for r in new["userpics"].collect()} == {(11, "old"), (12, "https://l-userpic.livejournal.com/12/8")}
    assert [tuple(r) for r in new["entry_userpics"].collect()] == [(257, 11)] and new["comment_userpics"].count() == 0
    assert [tuple(r) for r in new["entry_embeds"].select("ditemid", "idx", "url").collect()] == [(257, 0, "https://v.invalid/1")]


def test_audit(spark, tmp_path):
    ours = spark.createDataFrame([(1, "s", "One<br>two"), (2, "s", "One"), (3, "s", "x"), (4, "s", "x")], "ditemid bigint, shape string, html string")
    shown = spark.createDataFrame([(1, "One two", 1), (2, "One lost!", 1), (3, None, None)], "ditemid bigint, text string, breaks int")
    state = audit.verdicts(ours, shown)
    assert sorted(tuple(r) for r in state.collect()) == [(1, "s", 0, 0), (2, "s", 4, 1), (3, "s", -1, 0)]
    assert audit.rollup(state).first().asDict() == {"audited": 3, "parity": 1, "diverging": 2, "gaps": 1, "broken_lines": 1, "not_located": 1}
    pics = spark.createDataFrame([(1,), (2,), (3,)], "ditemid bigint")
    left = lambda **k: sorted(r[0] for r in audit.to_audit(ours.select("ditemid"), state, pics, **k).collect())
    assert left() == [3, 4] and left(recheck=True) == [2, 3, 4]
    audit.save(state, f"file://{tmp_path}/v")
    audit.save(state.where("ditemid = 3").withColumn("gap", F.lit(0)), f"file://{tmp_path}/v")
    assert sorted((r["ditemid"], r["gap"]) for r in audit.load(spark, f"file://{tmp_path}/v").collect()) == [(1, 0), (2, 4), (3, 0)]
    audit.save(state.where("ditemid = 1").withColumn("gap", F.lit(9)), f"file://{tmp_path}/v")
    assert audit.load(spark, f"file://{tmp_path}/v").where("ditemid = 1").first()["gap"] == 9
    assert [r["ditemid"] for r in audit.still_open(state).collect()] == [2]


def test_xml_redaction(spark):
    raw = '<comment id="3" user="Alice_B"><subject/><body a="1">Dear &lt;b&gt;Carol&lt;/b&gt; &amp; 42</body></comment>'
    event = f"<member><name>event</name><value><base64>{base64.b64encode('Für Dora <i>7</i>'.encode()).decode()}</base64></value></member><member><name>url</name><value><string>http://x.invalid/secret</string></value></member>"
    df = spark.createDataFrame([(raw,), (None,), ("",)], "xml string")
    got = df.select(xml.redact_xml(F.col("xml"), xml.COMMENTS, "pepper").alias("r")).select("r.*").collect()
    assert "Alice" not in got[0]["xml"] and "<subject/><body a=\"1\">xxxx &lt;b&gt;xxxxx&lt;/b&gt; &amp; 00</body>" in got[0]["xml"] and got[1]["xml"] is None
    assert {"Alice_B", "Dear", "Carol", "42"} <= set(got[0]["removed"])
    out, removed = xml.EVENTS.apply(event)
    plain = base64.b64decode(out.split("<base64>")[1].split("<")[0]).decode()
    assert plain == "xxx xxxx <i>0</i>" and "secret" not in out and "Dora" in removed
    done = spark.createDataFrame([(out,)], "text string")
    assert scrub.leaks(spark.createDataFrame([(r,) for r in removed], "value string"), done).count() == 0
    assert spark.range(1).select(unescape(F.lit("&amp;lt; &quot;&lt;"))).first()[0] == '&lt; "<'


def test_files_progress_sql_surface(spark, tmp_path, archive):
    folder = f"file://{tmp_path}/raw"
    assert files.capture(spark, lambda b: f"<{b}/>\n", [("a.xml", "a"), ("b.xml", "b")], folder) == 2
    assert sorted(tuple(r) for r in files.captured(spark, folder).collect()) == [("a.xml", "<a/>\n"), ("b.xml", "<b/>\n")]
    files.put(spark, f"file://{tmp_path}/b.json", '[{"id": 1, "html": "<p>",\n "context": "entry"}, {"id": 2}]')
    assert files.json_documents(spark, f"file://{tmp_path}/b.json", files.BODIES).count() == 2
    told = []
    df, finish = observed(spark.range(5), "five", told.append)
    df.collect()
    assert finish() == 5 and told == [Event("start", "five"), Event("done", "five", 5, "rows")]
    with pytest.raises(ValueError):
        Event("other")
    assert "missing_run" in daybook.register(spark)
    assert spark.sql("SELECT missing_run('abxyc', 'abc') AS n, redact_html('<p>ab 1') AS r, resolve_url('b', 'http://a.invalid/x') AS u").first()["n"] == 2
    links = spark.sql("SELECT l.place, l.url FROM VALUES ('<a href=b>x</a><a href=http://c.invalid/>y</a>'), (NULL) AS t(h), LATERAL page_links(h, 'http://a.invalid/') AS l")
    assert sorted(map(tuple, links.collect())) == [(0, "http://a.invalid/b"), (1, "http://c.invalid/")]
    gaps = spark.sql("SELECT * FROM longest_gaps(TABLE(SELECT * FROM VALUES ('a', DATE '2004-01-01'), ('a', DATE '2004-01-09'), ('a', DATE '2004-01-05'), ('a', NULL), ('b', DATE '2004-01-01') AS t(owner, day)) PARTITION BY owner ORDER BY day)")
    assert [tuple(r) for r in gaps.collect()] == [("a", "2004-01-01", "2004-01-05", 4)]
    refs = spark.sql("SELECT r.* FROM VALUES ('<img src=x.png alt=k>') AS t(h), LATERAL page_references(h, 'http://a.invalid/') AS r")
    assert [tuple(r) for r in refs.collect()] == [("http://a.invalid/x.png", "x.png", "k", "img")]
    assert daybook.query(archive[0], "SELECT count(*) AS n FROM entries WHERE itemid > :least", least=5).first()["n"] == 2
    assert all(getattr(daybook, name) is not None for name in daybook.__all__)
    with pytest.raises(AttributeError):
        daybook.nothing
    assert html.extract('<img src="a.png">', "http://h.invalid/")["images"]
