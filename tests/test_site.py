import hashlib
import pickle
import re

import pytest

from daybook import cli
from daybook.functions import scrub
from daybook.operators.store import Store
from daybook.plans import site
from daybook.schemas import TABLES


def test_build_and_status(spark, tmp_path, capsys):
    root, store = f"file://{tmp_path}/store", Store(spark, f"file://{tmp_path}/store")
    assert cli.main(["build", "--store", root, "--out", str(tmp_path / "site")], spark) == 2
    entry = (1, 0, 256, "2004-01-02 03:04", None, "A <title>", "one\n<img src='http://a.invalid/x.png'><script>x</script>", "public", None, None, None, None, None, None, {}, "now")
    store.upsert("entries", spark.createDataFrame([entry], TABLES["entries"][0]))
    store.upsert("entry_tags", spark.createDataFrame([(1, "My Tag")], TABLES["entry_tags"][0]))
    store.upsert("assets", spark.createDataFrame([("h", "image/png", 1, 1, 1, "ok", "blobs/h.png", "t")], TABLES["assets"][0]))
    store.upsert("asset_refs", spark.createDataFrame([(1, "h", "http://a.invalid/x.png", "a.invalid", "entry", 1, None, 200, None, "t")], TABLES["asset_refs"][0]))
    for _ in range(2):
        assert cli.main(["build", "--store", root, "--out", str(tmp_path / "site")], spark) == 0
    page = (tmp_path / "site/entries/256.html").read_text()
    assert "A &lt;title&gt;" in page and "blobs/h.png" in page and "<script" not in page
    assert "entries/256.html" in (tmp_path / "site/tags/my-tag.html").read_text()
    assert (tmp_path / "site/.gitignore").read_text() == "*\n"
    assert cli.main(["status", "--store", root], spark) == 0 and "entries\t1" in capsys.readouterr().out
    assert cli.main(["classify", "--store", root], spark) == 2


def test_blobs_once(spark, tmp_path):
    df = spark.createDataFrame([("blobs/ab/x.bin", b"1"), ("blobs/ab/x.bin", b"1"), ("blobs/cd/y.bin", None)], "path string, content binary")
    assert site.write_blobs(df, str(tmp_path)) == 1 and site.write_blobs(df, str(tmp_path)) == 0


def test_pseudonyms_by_first_appearance(spark):
    df = spark.createDataFrame([("b", 5), ("a", 20_000), ("b", 1), ("c", 2), (None, 0)], "name string, at long")
    assert {r.name: r.pseudonym for r in scrub.pseudonyms(df).collect()} == {"b": "user1", "c": "user2", "a": "user3"}


def test_nothing_removed_is_published(spark, tmp_path):
    removed = spark.createDataFrame([("Secretname",)], "value string")
    with pytest.raises(ValueError):
        scrub.publish(spark.createDataFrame([("the secretname here",)], "text string"), removed, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    scrub.publish(spark.createDataFrame([("xxx 000",)], "text string"), removed, str(tmp_path / "out"))


def test_secrets_stay():
    s = cli.Secret("pw")
    assert "pw" not in f"{s!r} {s}" and s.reveal() == "pw"
    with pytest.raises(TypeError):
        pickle.dumps(s)


LINK = re.compile(r'(?:href|src)="([^":]+\.(?:html|png|css)(?:#[^"]*)?)"')


def broken_links(root):
    """Relative links of all pages that lead to no file, those to images aside."""
    out = []
    for page in root.rglob("*.html"):
        for link in LINK.findall(page.read_text()):
            target = (page.parent / link.split("#")[0]).resolve()
            if not target.exists() and not link.endswith(".png"):
                out.append((str(page.relative_to(root)), link))
    return out


def test_a_whole_site(spark, tmp_path, monkeypatch):
    """Entries with threads, tags that share a slug, moods, music, people, pictures, embeds and own links: every link of every page leads somewhere."""
    monkeypatch.setattr(site, "ENTRIES", 3)
    monkeypatch.setattr(site, "COMMENTS", 4)
    s = Store(spark, f"file://{tmp_path}/store")
    bodies = ["see <a href='https://me-too.livejournal.com/512.html'>it</a> <lj user=some_one>", "<iframe src=x></iframe><lj-embed id=1>", "<table><tr><td>x</td>soup</table><b>open", "plain\ntext <img src='http://a.invalid/x.png'>"]
    entries = [(i, 0, 256 * i, f"200{4 + i % 3}-0{1 + i % 4}-1{i % 3} 0{i % 9}:04", None, None if i % 2 else f"Title <{i}>", bodies[i % 4], ("public", "private", "usemask")[i % 3], None, "Calm" if i % 3 else None, 7 if i % 3 == 0 else None, ("The Band - Song", "Song by band", None)[i % 3], "here" if i % 2 else None, None, {}, "t") for i in range(1, 14)]
    entries.append((20, 0, 5120, "never", None, "", "undated", "public", None, None, None, "!!!", None, None, {}, "t"))
    put = lambda name, rows: s.upsert(name, spark.createDataFrame(rows, TABLES[name][0]))
    put("entries", entries)
    put("entry_tags", [(1, "C++"), (2, "c"), (2, "Fun & Games"), (3, "c")])
    put("moods", [(7, "sleepy <3", None)])
    put("users", [(1, "me_too"), (2, "some_one"), (3, "Other")])
    put("comments", [(k, 2, k - 1 if k % 3 and k > 1 else None, (1, 2, 3, None)[k % 4], "s" if k % 2 else None, f"body {k} <script>x" if k % 5 else None, "2004-01-02T03:04:05Z", "ADSF"[k % 4], "t") for k in range(1, 12)] + [(50, 3, 49, 2, None, "lost parent", None, "A", "t")])
    put("assets", [("h", "image/png", 1, 1, 1, "ok", "blobs/h.png", "t")])
    put("asset_refs", [(1, "h", "http://a.invalid/x.png", "a.invalid", "entry", 3, "alt", 200, None, "t")])
    put("userpics", [(1, 1, "http://p.invalid/1", "key", "h", "t"), (2, 2, "http://p.invalid/2", None, "h", "t")])
    put("entry_userpics", [(256, 1)])
    put("entry_embeds", [(256, 0, "https://v.invalid/watch", "h", "t")])
    s.set_state("username", "me_too")
    root = tmp_path / "site"
    assert cli.build(spark, s, str(root)) == 0
    assert broken_links(root) == []
    read = lambda p: (root / p).read_text()
    kinds = {p.name for p in root.iterdir() if p.is_dir()}
    assert kinds >= {"entries", "days", "months", "years", "onthisday", "hours", "tags", "moods", "music", "people", "calendar", "images", "userpics"}
    assert 'href="../entries/512.html"' in read("entries/1024.html") and 'href="https://some-one.livejournal.com/"' in read("entries/1024.html")
    assert read("entries/256.html").count('href="https://v.invalid/watch"') == 1
    first = read("entries/512.html")
    assert "11 comments" in first and first.count('class="comment"') == 4 and "-p1.html" in first and "<script" not in first
    shown = "".join(read(f"entries/512{p}.html") for p in ("", "-p1", "-p2"))
    assert [int(x) for x in re.findall(r'id="c(\d+)"', shown)] == list(range(1, 12))
    assert "lost parent" in read("entries/768.html")
    assert {p.name for p in (root / "tags").glob("c*.html")} == {"c.html", "c-" + hashlib.md5(b"c").hexdigest()[:6] + ".html"}
    assert "entries/1024.html" in read("months/2005-01.html") or "Next:" in read("months/2005-01.html")
    assert "some_one" in read("people/index.html") and "me_too" not in read("people/index.html")
    assert "<td>14</td>" in read("retrospect.html") and "undated" in read("index.html") and 'href="calendar/2004.html"' in read("index.html")
    assert "days/" in read("calendar/2004.html")
    again = {p: p.read_text() for p in root.rglob("*.html")}
    assert cli.build(spark, s, str(root)) == 0
    assert {p: p.read_text() for p in root.rglob("*.html")} == again
