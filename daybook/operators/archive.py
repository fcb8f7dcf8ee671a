"""The datasets behind an archive's pages, as functions of the store's tables.

A slice is what a list of entries shares: a day, a month, a day of any year, an hour, a tag, a mood, an
artist, a person. All slices are rows of one shape, so that pages, indexes and counts are made of them
alike, and every list is cut into pages of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.functions import html, text
from daybook.operators import assets, pictures, threads
from daybook.operators.order import neighbours
from daybook.shared import written

#: Entries of a list page, comments of a page.
ENTRIES, COMMENTS = 200, 500
SECURITY = {"public": "public", "private": "private", "usemask": "friends"}
STATES = {"A": "visible", "D": "deleted", "S": "screened", "F": "frozen"}


def labelled(value: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[value], value)


class Archive:
    """``tables`` by name, as in the store; ``me`` is the owner's name, ``base`` the address of the journal."""

    def __init__(self, tables, me: str | None = None, base: str = ""):
        self.tables, self.me, self.base = tables, me or "", base.rstrip("/")
        self.host = base.split("://")[-1].split("/")[0].lower()
        self._written: dict[str, DataFrame] = {}

    def _kept(self, name: str, rows: DataFrame) -> DataFrame:
        """What many pages are made of, written once."""
        if name not in self._written:
            self._written[name] = written(rows)
        return self._written[name]

    def entries(self) -> DataFrame:
        """Entries with the parts of their time, title, mood by text or vocabulary, artist and song, and the number of their comments."""
        moods = self.tables["moods"].select("moodid", F.col("name").alias("_mood"))
        n = self.tables["comments"].groupBy(F.col("jitemid").alias("itemid")).agg(F.count("*").alias("comments"))
        p, (artist, song) = text.parts(F.col("eventtime")), text.split_music(F.coalesce("music", F.lit("")))
        e = self.tables["entries"].join(moods, "moodid", "left").join(n, "itemid", "left")
        dated = p["y"] > 0
        return self._written["entries"] if "entries" in self._written else self._kept("entries", e.select(
            "itemid", "ditemid", "eventtime", F.when(dated, F.substring("eventtime", 1, 10)).alias("day"), F.when(dated, F.substring("eventtime", 1, 7)).alias("month"), F.when(dated, p["y"]).alias("year"),
            F.when(dated, F.substring("eventtime", 6, 5)).alias("md"), F.when(dated, p["hh"]).alias("hour"), text.title(F.col("subject"), F.col("body")).alias("title"), labelled(F.col("security"), SECURITY).alias("security"),
            F.coalesce("mood", "_mood").alias("mood"), F.nullif(artist, F.lit("")).alias("artist"), song.alias("song"), "location", "body",
            F.coalesce(F.map_contains_key("props", F.lit("opt_preformatted")), F.lit(False)).alias("preformatted"), F.coalesce("comments", F.lit(0)).cast("long").alias("comments"),
        ))

    def tag_slugs(self) -> DataFrame:
        """tag, slug: the first tag of a slug keeps it, others get a part of their digest."""
        base = self.tables["entry_tags"].select("tag").distinct().withColumn("base", text.slugify(F.col("tag")))
        rank = F.row_number().over(Window.partitionBy("base").orderBy("tag"))
        return base.select("tag", F.when(rank == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.substring(F.md5("tag"), 1, 6))).alias("slug"))

    def artists(self) -> DataFrame:
        """key, name: the most frequent spelling of an artist, the smaller one at a tie."""
        named = self.entries().where("artist is not null").select(text.music_key(F.col("artist")).alias("key"), "artist").where("key <> ''")
        per = named.groupBy("key", "artist").agg(F.count("*").alias("n"))
        return per.groupBy("key").agg(F.min(F.struct(-F.col("n"), "artist"))["artist"].alias("name"))

    def slices(self) -> DataFrame:
        """kind, slug, name, itemid, note: every list that an entry is on. People's notes count their comments."""
        if "slices" in self._written:
            return self._written["slices"]
        e = self.entries()
        of = lambda rows, kind, slug, name, note: rows.where(slug.isNotNull() & (slug != "")).select(F.lit(kind).alias("kind"), slug.alias("slug"), name.alias("name"), "itemid", note.cast("string").alias("note"))
        none = F.lit(None)
        out = of(e, "days", F.col("day"), F.col("day"), none)
        for kind, c in (("months", "month"), ("onthisday", "md"), ("hours", "hour")):
            out = out.union(of(e, kind, F.col(c), F.col(c), none))
        out = out.union(of(e, "years", F.col("year").cast("string"), F.col("year").cast("string"), none))
        out = out.union(of(self.tables["entry_tags"].join(self.tag_slugs(), "tag").join(e.select("itemid"), "itemid", "left_semi"), "tags", F.col("slug"), F.col("tag"), none))
        mood = e.where(F.btrim(F.coalesce("mood", F.lit(""))) != "").withColumn("slug", text.slugify(F.col("mood")))
        names = mood.groupBy("slug").agg(F.min("mood").alias("name"))  # spellings that share a slug share a page
        out = out.union(of(mood.join(names, "slug"), "moods", F.col("slug"), F.col("name"), none))
        music = e.withColumn("key", text.music_key(F.coalesce("artist", F.lit("")))).join(self.artists(), "key")
        out = out.union(of(music, "music", F.col("key"), F.col("name"), F.col("song")))
        return self._kept("slices", out.union(of(self.people(), "people", text.slugify(F.col("username")), F.col("username"), F.col("n"))))

    def people(self) -> DataFrame:
        """username, itemid, n: the comments of everybody but the owner on each entry; anonymous ones have no row."""
        own = self.tables["comments"].join(self.tables["users"], "posterid").where(F.col("username") != self.me)
        per = own.groupBy("username", F.col("jitemid").alias("itemid")).agg(F.count("*").alias("n"))
        return per.join(self.tables["entries"].select("itemid"), "itemid", "left_semi")

    def rail(self) -> DataFrame:
        """A row for each year: entries, days of the year with entries."""
        return self.entries().where("year is not null").groupBy("year").agg(F.count("*").alias("n"), F.count_distinct("md").alias("dates"))

    def comments(self) -> DataFrame:
        """Comments in reading order: itemid, id, place, depth, who (null: anonymous), state, date, subject, body. Those on a cycle come last."""
        if "comments" in self._written:
            return self._written["comments"]
        c = self.tables["comments"]
        order = threads.reading_order(c.select(F.col("jitemid").alias("tree"), "id", F.col("parentid").alias("parent"))).withColumnRenamed("tree", "jitemid")
        met = c.join(self.tables["users"], "posterid", "left").join(order, ["jitemid", "id"])
        last = F.coalesce("place", F.lit(1 << 40) + F.col("id"))
        shown = met.select(F.col("jitemid").alias("itemid"), "id", last.alias("place"), F.coalesce("depth", F.lit(1)).alias("depth"), F.col("username").alias("who"), labelled(F.col("state"), STATES).alias("state"), "date", "subject", "body")
        return self._kept("comments", shown)

    def neighbours(self) -> DataFrame:
        """itemid with ditemid and title of the entries before and behind, in the order of the whole archive."""
        near = neighbours(self.entries().select("eventtime", "itemid", "ditemid", "title"), ["eventtime", "itemid"], ["ditemid", "title"])
        return near.select("itemid", "prev_ditemid", "prev_title", "next_ditemid", "next_title")

    def rendered(self, rows: DataFrame, context: str, key: str) -> DataFrame:
        """Rows (key, ditemid, body, preformatted) -> key, html: images by their references, links to own entries that are held, posters of entries' embeds."""
        refs = self.tables["asset_refs"]
        live, dead = assets.live_paths(refs, self.tables["assets"]), assets.lost_reasons(refs)
        found = refs.where(F.col("context") == context).select(F.col("context_id").alias(key), "source_url").distinct().join(live, "source_url", "left").join(dead, "source_url", "left")
        pairs = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("source_url", c))))
        maps = found.groupBy(key).agg(pairs("local_path").alias("live"), pairs("reason").alias("dead"))
        links = rows.select(key, F.explode_outer(html.extract_udf(F.col("body"), F.lit(self.base + "/"))["links"]).alias("url")).where("url is not null")  # outer: no test of sizes that runs the function twice
        own = links.select(key, text.self_item(F.col("url"), F.lit(self.host)).alias("ditemid")).where("ditemid is not null").distinct()
        held = own.join(self.tables["entries"].select("ditemid"), "ditemid", "left_semi").groupBy(key).agg(F.collect_list("ditemid").alias("held"))
        shown = self.tables["entry_embeds"].where(F.col("thumb_hash").isNotNull()).groupBy("ditemid").agg(F.map_from_entries(F.collect_list(F.struct("idx", "url"))).alias("urls"))
        posters = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("urls"))), lambda i: F.element_at("urls", i))
        none = F.create_map().cast("map<string,string>")
        met = rows.join(maps, key, "left").join(held, key, "left").join(shown, "ditemid", "left")
        out = html.render_column(F.col("body"), F.coalesce("live", none), F.coalesce("dead", none), F.col("held"), F.lit(self.host), F.col("preformatted"), posters if context == "entry" else None)
        return met.select(key, out.alias("html"))

    def gallery(self) -> DataFrame:
        """Images that can be shown, each once with the entry it is on: hash, local_path, alt, itemid."""
        ok = self.tables["assets"].where("status = 'ok' and local_path is not null").select("hash", "local_path")
        refs = self.tables["asset_refs"].join(ok, "hash")
        told = self.tables["comments"].select(F.col("id").alias("context_id"), F.lit("comment").alias("context"), "jitemid")
        met = refs.join(told, ["context", "context_id"], "left").withColumn("itemid", F.when(F.col("context") == "comment", F.col("jitemid")).otherwise(F.col("context_id")))
        known = met.where(F.col("context").isin("entry", "comment")).join(self.tables["entries"].select("itemid", "ditemid"), "itemid")
        first = F.min(F.struct(F.col("alt_text").isNull(), "alt_text", "context", "context_id", "ditemid", "local_path"))
        return known.groupBy("hash").agg(first.alias("f")).select("hash", "f.local_path", F.col("f.alt_text").alias("alt"), "f.ditemid")

    def userpics(self) -> DataFrame:
        """Stored pictures: who, keyword, local_path, uses on entries; the owner's own first."""
        uses = self.tables["entry_userpics"].groupBy("picid").agg(F.count("*").alias("uses"))
        ok = self.tables["assets"].where("status = 'ok'").select("hash", "local_path")
        pics = self.tables["userpics"].join(ok, "hash").join(uses, "picid", "left").join(self.tables["users"].select(F.col("posterid").alias("userid"), F.col("username").alias("who")), "userid", "left")
        return pics.select("picid", "who", "keyword", "local_path", F.coalesce("uses", F.lit(0)).alias("uses"), F.col("who").eqNullSafe(self.me).alias("own"))

    def retrospect(self) -> DataFrame:
        """measure, value of the whole archive."""
        e = self.entries()
        n = F.count("*")
        top = lambda column: F.min(F.struct(-F.col("n"), column))[column]
        one = e.agg(
            n.alias("entries"), F.sum("comments").alias("comments"), F.min("day").alias("first"), F.max("day").alias("last"), text.percent(F.count_if(F.col("security") == "private"), n).alias("private_pct"),
            text.percent(F.count_if(F.col("security") == "friends"), n).alias("friends_pct"), F.min(F.struct(-text.words(F.col("body")), "eventtime", "ditemid"))["ditemid"].alias("longest"), F.min(F.struct(-F.col("comments"), "eventtime", "ditemid"))["ditemid"].alias("most_commented"),
        )
        rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("value")) for c in one.columns))).alias("r")).select("r.*")
        for name, kind in (("busiest_day", "days"), ("top_hour", "hours"), ("top_mood", "moods"), ("top_tag", "tags"), ("top_artist", "music")):
            rows = rows.union(self.slices().where(F.col("kind") == kind).groupBy("name").agg(n.alias("n")).agg(top("name").alias("value")).select(F.lit(name), "value"))
        deep = self.comments().agg(F.max("depth").cast("string").alias("value")).select(F.lit("deepest_thread"), "value")
        pics = pictures.stats(self.tables["userpics"], "hash").select(F.lit("userpics"), F.col("stored").cast("string"))
        return rows.union(deep).union(pics)
