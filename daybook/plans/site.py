"""The site's files: pages rendered from datasets, blobs, styles. Executors write; the driver only plans."""

from __future__ import annotations

import os
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.functions import text
from daybook.operators.archive import COMMENTS, ENTRIES, Archive

STYLE = "body{max-width:44rem;margin:2rem auto;font:1rem/1.5 serif}.lost{opacity:.6;border:1px dashed}.heat1{background:#eef}.heat2{background:#ccf}.heat3{background:#88f}details{border-left:3px solid #ccc;padding-left:1rem}"


def layout(title: str, body: str, path: str) -> str:
    root = "../" * path.count("/")
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{escape(title)}</title><link rel="stylesheet" href="{root}style.css"><body><nav><a href="{root}index.html">Home</a></nav><main>{body}</main></body></html>\n'


#: A file by which tasks see that the folder they write to is the one that was started.
SHARED = ".daybook-site"


def _seen(root: str) -> None:
    if not os.path.exists(os.path.join(root, SHARED)):
        raise RuntimeError(f"{root} is not the folder that the driver started: name one that all executors share")


def write_files(pages: DataFrame, root: str) -> int:
    """(path, title, body) -> files below ``root``, a folder that ``start`` made and all executors share; returns how many. Writing twice gives the same files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _seen(root)
        for b in batches:
            for path, title, body in zip(b["path"], b["title"], b["body"]):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.part", "w", encoding="utf-8") as f:
                    f.write(layout(title or "", body or "", path))
                os.replace(f"{target}.part", target)
            yield pd.DataFrame({"n": [len(b)]})

    total = pages.select("path", "title", "body").mapInPandas(run, "n long").agg(F.sum("n")).first()[0]
    return total or 0


def write_blobs(blobs: DataFrame, root: str) -> int:
    """(path, content) -> content-addressed files in a folder that all executors share; those that exist are left alone."""
    start(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _seen(root)
        for b in batches:
            new = 0
            for path, content in zip(b["path"], b["content"]):
                target = os.path.join(root, path)
                if not os.path.exists(target):
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(f"{target}.part", "wb") as f:
                        f.write(content)
                    os.replace(f"{target}.part", target)
                    new += 1
            yield pd.DataFrame({"n": [new]})

    return blobs.where("content is not null").dropDuplicates(["path"]).select("path", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def esc(c: Column | str) -> Column:
    return text.escape_html(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def joined(*parts: Column | str) -> Column:
    """Strings as they are, columns as text; null is nothing."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _cut(rows: DataFrame, key: list[str], order: list[Column], item: Column, most: int) -> DataFrame:
    """Rows -> key, page (from 0), pages, items: a row for each ``most`` rows of a key, in order, so that no list is one row."""
    w = Window.partitionBy(*key).orderBy(*order)
    placed = rows.withColumn("_at", F.row_number().over(w) - 1).withColumn("page", F.floor(F.col("_at") / most).cast("int"))
    items = placed.groupBy(*key, "page").agg(F.array_join(F.sort_array(F.collect_list(F.struct("_at", item.alias("item"))))["item"], "").alias("items"))
    pages = rows.groupBy(*key).agg(F.ceil(F.count("*") / most).cast("int").alias("pages"))
    return items.join(pages, key)


def _numbered(stem: Column) -> Column:
    return F.concat(stem, F.when(F.col("page") > 0, F.concat(F.lit("-p"), F.col("page").cast("string"))).otherwise(""), F.lit(".html"))


def _turn(slug: Column) -> Column:
    """Links to the page before and behind of a list that is cut."""
    link = lambda step, label: F.concat(F.lit('<a href="'), slug, F.when(F.col("page") + step > 0, F.concat(F.lit("-p"), (F.col("page") + step).cast("string"))).otherwise(""), F.lit(f'.html">{label}</a> '))
    return F.concat(F.lit("<p>"), F.when(F.col("page") > 0, link(-1, "Back")).otherwise(""), F.when(F.col("page") + 1 < F.col("pages"), link(1, "More")).otherwise(""), F.lit("</p>"))


def _line(root: str = "../") -> Column:
    """An entry in a list."""
    return joined(f'<li><a href="{root}entries/', F.col("ditemid"), '.html">', esc("title"), "</a> <small>", F.col("eventtime"), F.when(F.col("comments") > 0, joined(" · ", F.col("comments"), " comments")), F.when(F.col("note").isNotNull(), joined(" · ", esc("note"))), "</small></li>")


def list_pages(archive: Archive) -> DataFrame:
    """A page for each slice, newest entries first, and the next and previous one of those that time orders."""
    e = archive.entries().select("itemid", "ditemid", "title", "eventtime", "comments")
    rows = archive.slices().join(e, "itemid")
    lists = _cut(rows, ["kind", "slug", "name"], [F.desc("eventtime"), F.desc("itemid")], _line(), ENTRIES)
    timed = rows.where(F.col("kind").isin("days", "months", "years", "onthisday")).select("kind", "slug").distinct()  # days of a calendar
    w = Window.partitionBy("kind").orderBy("slug")
    near = timed.withColumn("prev", F.lag("slug").over(w)).withColumn("next", F.lead("slug").over(w))
    met = lists.join(near, ["kind", "slug"], "left")
    beside = lambda c, label: F.when(F.col(c).isNotNull(), F.concat(F.lit('<a href="'), F.col(c), F.lit(f'.html">{label} '), F.col(c), F.lit("</a> "))).otherwise("")
    body = joined("<h1>", esc("name"), '</h1><p><a href="index.html">All</a> ', beside("prev", "Before:"), beside("next", "Next:"), "</p><ul>", F.col("items"), "</ul>", _turn(F.col("slug")))
    return met.select(_numbered(F.concat("kind", F.lit("/"), "slug")).alias("path"), F.col("name").alias("title"), body.alias("body"))


def index_pages(archive: Archive) -> DataFrame:
    """What slices there are of each kind, with their entries counted: by name where time orders them, else the largest first."""
    counts = archive.slices().groupBy("kind", "slug", "name").agg(F.count("*").alias("n"))
    timed = F.col("kind").isin("days", "months", "years", "onthisday", "hours")
    item = joined('<li><a href="', F.col("slug"), '.html">', esc("name"), "</a> ", F.col("n"), "</li>")
    lists = _cut(counts, ["kind"], [F.when(timed, F.col("slug")), F.desc("n"), "name"], item, COMMENTS)
    body = joined("<h1>", F.col("kind"), "</h1><ul>", F.col("items"), "</ul>", _turn(F.lit("index")))
    return lists.select(_numbered(F.concat("kind", F.lit("/index"))).alias("path"), F.col("kind").alias("title"), body.alias("body"))


def calendar_pages(archive: Archive) -> DataFrame:
    """Every year as twelve months of weeks, days with entries as links."""
    from daybook.plans.aggregates import calendar

    days = archive.entries().where("day is not null").select(F.col("day").try_cast("date").alias("day")).where("day is not null")
    peak = days.groupBy("day").count().agg(F.greatest(F.max("count"), F.lit(1)).alias("peak"))
    cells = calendar(days).crossJoin(F.broadcast(peak))  # one row
    day = joined(F.col("y"), "-", F.lpad(F.col("m").cast("string"), 2, "0"), "-", F.lpad(F.col("d").cast("string"), 2, "0"))
    shown = F.when(F.col("n") > 0, joined('<a class="heat', text.heat(F.col("n"), F.col("peak")), '" href="../days/', day, '.html">', F.col("d"), "</a>")).otherwise(F.col("d").cast("string"))
    cell = joined(F.when(F.col("weekday") == 0, F.lit("<tr>")), F.when((F.col("d") == 1) & (F.col("weekday") > 0), joined("<tr>", F.repeat(F.lit("<td></td>"), F.col("weekday")))), "<td>", shown, "</td>")
    months = cells.groupBy("y", "m").agg(F.array_join(F.sort_array(F.collect_list(F.struct("d", cell.alias("c"))))["c"], "").alias("cells"))
    table = joined("<table><caption>", F.col("y"), "-", F.lpad(F.col("m").cast("string"), 2, "0"), "</caption>", F.col("cells"), "</table>")
    years = months.groupBy("y").agg(F.array_join(F.sort_array(F.collect_list(F.struct("m", table.alias("t"))))["t"], "").alias("tables"))
    return years.select(joined("calendar/", F.col("y"), ".html").alias("path"), F.col("y").cast("string").alias("title"), joined("<h1>", F.col("y"), "</h1>", F.col("tables")).alias("body"))


def comment_parts(archive: Archive) -> DataFrame:
    """itemid, page, pages, items: comments in reading order, indented by their depth, some hundred a page."""
    c = archive.comments()
    owner = c.join(archive.entries().select("itemid", "ditemid"), "itemid")
    shown = archive.rendered(owner.select("id", "ditemid", "body", F.lit(False).alias("preformatted")), "comment", "id")
    who = F.when(F.col("who").isNull(), F.lit("anonymous")).otherwise(F.concat(F.lit('<a href="../people/'), text.slugify(F.col("who")), F.lit('.html">'), esc("who"), F.lit("</a>")))
    who = F.when(F.col("who") == archive.me, esc("who")).otherwise(who)
    state = F.when(F.col("state") != "visible", joined(" · ", F.col("state")))
    item = joined('<div class="comment" style="margin-left:', F.least("depth", F.lit(30)) - 1, 'em" id="c', F.col("id"), '"><p>', who, " · ", F.col("date"), state, "</p>", F.when(F.col("subject").isNotNull(), joined("<h3>", esc("subject"), "</h3>")), F.coalesce("html", F.lit("<i>no text</i>")), "</div>")
    return _cut(c.join(shown, "id"), ["itemid"], [F.col("place")], item, COMMENTS)


def entry_pages(archive: Archive) -> DataFrame:
    """A page for each entry with what it says of itself, its neighbours and its comments; more pages for comments beyond the first hundreds."""
    e = archive.entries()
    tags = archive.tables["entry_tags"].join(archive.tag_slugs(), "tag").groupBy("itemid").agg(F.array_join(F.sort_array(F.collect_list(joined('<a href="../tags/', F.col("slug"), '.html">', esc("tag"), "</a>"))), ", ").alias("tags"))
    parts = comment_parts(archive).withColumnRenamed("items", "told")
    met = e.drop("body", "preformatted").join(archive.rendered(e, "entry", "itemid"), "itemid").join(archive.neighbours(), "itemid").join(tags, "itemid", "left")
    both = met.join(parts, "itemid", "left").withColumn("page", F.coalesce("page", F.lit(0))).withColumn("pages", F.coalesce("pages", F.lit(1)))
    fact = lambda label, c, kind=None, slug=None: F.when(F.col(c).isNotNull() & (F.col(c) != ""), joined(f"<dt>{label}</dt><dd>", joined(f'<a href="../{kind}/', slug, '.html">', esc(c), "</a>") if kind else esc(c), "</dd>"))
    when = F.when(F.col("day").isNotNull(), joined('<a href="../days/', F.col("day"), '.html">', F.col("eventtime"), "</a>")).otherwise(F.col("eventtime"))
    key = text.music_key(F.coalesce("artist", F.lit("")))
    artist = F.when(key != "", fact("Music", "artist", "music", key)).otherwise(fact("Music", "artist"))
    facts = joined("<dl>", fact("Mood", "mood", "moods", text.slugify(F.col("mood"))), artist, fact("Song", "song"), fact("Place", "location"), F.when(F.col("security") != "public", joined("<dt>Seen by</dt><dd>", F.col("security"), "</dd>")), F.when(F.col("tags").isNotNull(), joined("<dt>Tags</dt><dd>", F.col("tags"), "</dd>")), "</dl>")
    beside = lambda way, label: F.when(F.col(f"{way}_ditemid").isNotNull(), joined(f'<a rel="{way}" href="', F.col(f"{way}_ditemid"), f'.html">{label} ', esc(f"{way}_title"), "</a> "))
    first = joined("<article>", F.col("html"), "</article>", facts)
    body = joined("<h1>", esc("title"), "</h1><p>", when, "</p>", F.when(F.col("page") == 0, first), "<p>", beside("prev", "Before:"), beside("next", "Next:"), "</p><section><h2>", F.col("comments"), " comments</h2>", F.col("told"), "</section>", _turn(F.col("ditemid").cast("string")))
    return both.select(_numbered(F.concat(F.lit("entries/"), F.col("ditemid").cast("string"))).alias("path"), "title", body.alias("body"))


def other_pages(archive: Archive) -> DataFrame:
    """The gallery, the pictures of people, the dashboard and the home page with the thirty newest entries."""
    picture = joined('<figure><a href="../entries/', F.col("ditemid"), '.html"><img loading="lazy" src="../', F.col("local_path"), '" alt="', esc("alt"), '"></a></figure>')
    gallery = _cut(archive.gallery().withColumn("one", F.lit(1)), ["one"], [F.col("ditemid"), F.col("hash")], picture, ENTRIES)
    out = gallery.select(_numbered(F.lit("images/index")).alias("path"), F.lit("Images").alias("title"), joined("<h1>Images</h1>", F.col("items"), _turn(F.lit("index"))).alias("body"))
    pic = joined('<figure><img loading="lazy" src="../', F.col("local_path"), '" alt="', esc("keyword"), '"><figcaption>', esc("who"), " ", esc("keyword"), " ", F.col("uses"), "</figcaption></figure>")
    pics = _cut(archive.userpics().withColumn("one", F.lit(1)), ["one"], [F.desc("own"), F.desc("uses"), F.col("picid")], pic, ENTRIES)
    out = out.union(pics.select(_numbered(F.lit("userpics/index")), F.lit("Pictures"), joined("<h1>Pictures</h1>", F.col("items"), _turn(F.lit("index")))))
    rows = archive.retrospect().agg(F.array_join(F.sort_array(F.collect_list(joined("<tr><th>", F.col("measure"), "</th><td>", esc("value"), "</td></tr>"))), "").alias("t"))  # a row for each measure
    out = out.union(rows.select(F.lit("retrospect.html"), F.lit("Retrospect"), joined("<h1>Retrospect</h1><table>", F.col("t"), "</table>")))
    recent = archive.entries().withColumn("note", F.lit(None).cast("string")).orderBy(F.desc("eventtime"), F.desc("itemid")).limit(30)
    lines = recent.agg(F.array_join(F.sort_array(F.collect_list(F.struct("eventtime", "itemid", _line("").alias("line"))), asc=False)["line"], "").alias("lines"))
    years = archive.rail().agg(F.array_join(F.sort_array(F.collect_list(joined('<li><a href="calendar/', F.col("year"), '.html">', F.col("year"), "</a> ", F.col("n"), "</li>"))), "").alias("years"))
    kinds = archive.slices().select("kind").distinct().agg(F.array_join(F.sort_array(F.collect_list(joined('<li><a href="', F.col("kind"), '/index.html">', F.col("kind"), "</a></li>"))), "").alias("kinds"))
    home = lines.crossJoin(F.broadcast(years)).crossJoin(F.broadcast(kinds))  # one row each
    return out.union(home.select(F.lit("index.html"), F.lit("Home"), joined("<h1>Recent</h1><ul>", F.col("lines"), "</ul><h2>Years</h2><ul>", F.col("years"), "</ul><h2>Lists</h2><ul>", F.col("kinds"), '</ul><p><a href="retrospect.html">Retrospect</a></p>')))


def all_pages(archive: Archive) -> list[DataFrame]:
    return [entry_pages(archive), list_pages(archive), index_pages(archive), calendar_pages(archive), other_pages(archive)]


def start(root: str) -> None:
    """The folder with its styles and a guard that keeps it out of version control."""
    os.makedirs(root, exist_ok=True)
    for name, text in (("style.css", STYLE), (".gitignore", "*\n"), (SHARED, "")):
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            f.write(text)
