"""From bodies to local images: references, downloads by host, blobs by content, placeholders flagged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions import html, media, text
from daybook.operators import assets, pictures
from daybook.operators.store import Store, Transaction, fetched_blobs, fetched_refs, flag_poison, update_some
from daybook.progress import Event, Reporter, silent
from daybook.streaming.work import drain


def bodies(store: Store, base: str) -> DataFrame:
    """context, context_id, base, html of all entries and comments; relative addresses resolve against the entry's page."""
    page = lambda c: F.concat(F.lit(base.rstrip("/") + "/"), c.cast("string"), F.lit(".html"))
    entries = store.read("entries")
    own = entries.select(F.lit("entry").alias("context"), F.col("itemid").alias("context_id"), page(F.col("ditemid")).alias("base"), F.col("body").alias("html"))
    told = store.read("comments").join(entries.select(F.col("itemid").alias("jitemid"), "ditemid"), "jitemid").where("body is not null")
    return own.unionByName(told.select(F.lit("comment").alias("context"), F.col("id").alias("context_id"), page(F.col("ditemid")).alias("base"), F.col("body").alias("html")))


def references(bodies: DataFrame) -> DataFrame:
    """Every occurrence of an image: source_url, host, context, context_id, alt_text."""
    found = bodies.select("context", "context_id", F.explode(html.extract_udf(F.col("html"), F.col("base"))["images"]).alias("i"))
    return found.select(F.col("i.url").alias("source_url"), text.host_of(F.col("i.url")).alias("host"), "context", "context_id", F.col("i.alt").alias("alt_text"))


def totals(bodies: DataFrame) -> DataFrame:
    """One row: bodies, occurrences of images, references (an image counts once a body), users, embeds, cuts."""
    x = bodies.select(html.extract_udf(F.col("html"), F.col("base")).alias("x"))
    size = lambda c: F.sum(F.size(c)).cast("bigint")
    return x.agg(
        F.count("*").alias("bodies"), size("x.images").alias("occurrences"), size(F.array_distinct("x.images.url")).alias("refs"),
        size("x.users").alias("users"), size("x.embeds").alias("embeds"), F.count_if(F.col("x.has_cut")).alias("cuts"),
    )


def hosts_in(html: Column) -> Column:
    """Lower-case hosts of all addresses in src and href, with repeats."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)(?:src|href)\s*=\s*["']?(?:https?:)?//([^/"'\s>]+)"""), F.lit(1)), F.lower)


def concentrated(bodies: DataFrame, key: str, least: int = 3, most_hosts: int = 2, top: int = 8) -> DataFrame:
    """The bodies (key, html) with most references to few hosts: key, refs, hosts; ties by key."""
    n = bodies.select(key, hosts_in(F.col("html")).alias("h")).select(key, F.size("h").cast("bigint").alias("refs"), F.size(F.array_distinct("h")).cast("bigint").alias("hosts"))
    return n.where((F.col("refs") >= least) & (F.col("hosts") <= most_hosts)).orderBy(F.desc("refs"), key).limit(top)


def outcomes(kept: DataFrame, out: str, now: str) -> DataFrame:
    """Fetches as they landed -> what they are (source_url, hash, mime, sizes, status, local_path, ...), with the images written below ``out``."""
    size, mime = media.read_size(F.col("content")), media.sniff_mime(F.col("content"))
    told = kept.withColumn("size", size).withColumn("v", media.classify(F.col("http_status"), F.col("error"), F.col("content"), F.col("size"))).withColumn("mime", mime)
    ok = F.col("v.status") == "ok"
    ext = F.create_map(*(F.lit(x) for pair in media.EXTENSIONS.items() for x in pair))[F.col("mime")]
    rows = told.select(
        F.col("url").alias("source_url"), F.when(ok, F.col("hash")).alias("hash"), F.coalesce("mime", F.lit("")).alias("mime"), F.octet_length("content").cast("bigint").alias("byte_len"),
        F.col("size.width").alias("width"), F.col("size.height").alias("height"), F.col("v.status").alias("status"), F.when(ok, text.blob_path(F.col("hash"), ext)).alias("local_path"),
        "http_status", F.col("v.reason").alias("error"), F.lit(now).alias("fetched_at"), "content",
    )
    from daybook.plans.site import write_blobs

    write_blobs(rows.where("hash is not null").select(F.col("local_path").alias("path"), "content"), out)
    return rows.drop("content")


def record(tx: Transaction, results: DataFrame) -> None:
    """Outcomes of fetches, for the references of their addresses and as blobs, in one transaction."""
    tx.merge("asset_refs", results, fetched_refs)
    tx.merge("assets", results.where("hash is not null"), fetched_blobs)


def images(store: Store, base: str, get, out: str, now: str, report: Reporter = silent, **pace) -> dict:
    """References of all bodies, downloads of what was not tried yet, placeholders by host collapse; returns the statistics."""
    report(Event("start", "images"))
    found = references(bodies(store, base)).dropDuplicates(["source_url", "context", "context_id"])
    found = found.withColumn("id", F.xxhash64("source_url", "context", "context_id"))
    store.merge("asset_refs", found, lambda old, new: update_some(old, new, ["source_url", "context", "context_id"], ["id", "host", "alt_text"]))
    drain(store, "images", lambda: assets.pending(store.read("asset_refs")).select(F.col("source_url").alias("url")), get, out, now, record, **pace)
    collapsed = assets.host_collapse(store.read("asset_refs").withColumnRenamed("source_url", "url"))
    store.merge("assets", collapsed, flag_poison)
    stats = assets.image_stats(store.read("asset_refs"), store.read("assets")).first().asDict()
    report(Event("done", "images", stats["ok"], "images stored"))
    return stats


def userpics(store: Store, get, out: str, now: str, report: Reporter = silent, **pace) -> dict:
    """Downloads untried userpics; all pictures of an address are linked."""
    return _linked(store, "userpics", lambda: pictures.untried(store.read("userpics")).select("url"), "hash", get, out, now, report, pace)


def video_posters(store: Store, get, out: str, now: str, report: Reporter = silent, **pace) -> dict:
    """Downloads the posters of untried embeds whose address names a video; the others stay untried."""
    urls = lambda: pictures.untried(store.read("entry_embeds")).select(text.video_thumb(F.col("url")).alias("url")).where("url is not null")
    return _linked(store, "entry_embeds", urls, "thumb_hash", get, out, now, report, pace)


def _linked(store: Store, name: str, urls: Callable[[], DataFrame], column: str, get, out: str, now: str, report: Reporter, pace: dict) -> dict:
    report(Event("start", name))

    def change(tx: Transaction, results: DataFrame) -> None:
        tried = results.select(F.col("source_url").alias("url"), "hash")
        tx.merge("assets", results.where("hash is not null"), fetched_blobs)
        rows = pictures.untried(tx.read(name))
        if name == "userpics":
            new = pictures.link_userpics(rows, tried, now)
        else:
            asked = rows.select("ditemid", "idx", text.video_thumb(F.col("url")).alias("url"))
            new = pictures.link_posters(rows, asked.join(tried, "url").select("ditemid", "idx", "hash"), now)
        tx.upsert(name, new.where("fetched_at is not null"))

    drain(store, name, urls, get, out, now, change, **pace)
    stats = pictures.stats(store.read(name), column).first().asDict()
    report(Event("done", name, stats["stored"], "stored"))
    return stats
