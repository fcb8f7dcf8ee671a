"""From a journal server into the store: login, entries backwards through time, comments upwards by id.

The server hands out small pages one after another, so the driver holds one page at a time; each is
upserted before its cursor is stored, and a run that was killed goes on where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.text import split_tags
from daybook.operators.store import Store, Transaction, replace_tags, settled, upsert
from daybook.progress import Event, Reporter, silent
from daybook.schemas import TABLES
from daybook.sources import comments, files, paging, xmlrpc

PAGE = 50


class _State(dict):
    """The cursors, kept in the store: a change is stored at once."""

    def __init__(self, store: Store, prefix: str):
        self.store, self.prefix = store, prefix
        super().__init__(json.loads(store.get_state(prefix) or "{}"))

    def _save(self) -> None:
        self.store.set_state(self.prefix, json.dumps(self))

    def __setitem__(self, key, value) -> None:
        super().__setitem__(key, value)
        self._save()

    def __ior__(self, other):
        super().update(other)
        self._save()
        return self


def _request(client: paging.Client, user: str, digest: str, method: str, params: dict) -> str:
    """Challenges serve once, so each request asks for one of its own. ``digest`` is the MD5 of the password, in hex."""
    challenge = xmlrpc.decode_response(client.request(xmlrpc.encode_request("LJ.XMLRPC.getchallenge", {})))["challenge"]
    auth = {"username": user, "auth_method": "challenge", "auth_challenge": challenge, "auth_response": xmlrpc.reply_to(challenge, digest), "ver": 1}
    return client.request(xmlrpc.encode_request(f"LJ.XMLRPC.{method}", auth | params))


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def put_entries(store: Store, page: DataFrame) -> int:
    """Entries with taglist -> entries and their tags, both in one transaction; returns how many were new. Only buckets of the page's ids are written."""
    page = settled(page.withColumn("fetched_at", F.lit(_now())), ["itemid"])
    tags = page.select("itemid", F.coalesce(split_tags(F.col("taglist")), F.array().cast("array<string>")).alias("tags"))

    def change(tx: Transaction) -> int:
        fresh = []

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            fresh.append(new.join(old.select("itemid"), "itemid", "left_anti").count())
            return upsert(old, new, ["itemid"])

        tx.merge("entries", page.drop("taglist"), merged)
        tx.merge("entry_tags", tags, replace_tags)
        return sum(fresh)

    return store.transact(change)


def sync_entries(store: Store, ask: Callable[[str, dict], str], report: Reporter = silent) -> int:
    report(Event("start", "entries"))

    def fetch(before: str | None, many: int = PAGE) -> list[dict]:
        return xmlrpc.events_of(ask("getevents", {"selecttype": "lastn", "howmany": many, "beforedate": before}))

    def commit(page: list[dict]) -> int:
        new = put_entries(store, store.spark.createDataFrame([(page,)], f"e {xmlrpc.EVENTS}").select(F.inline("e")))
        report(Event("tick", "entries", new))
        return new

    n = paging.backwards(fetch, commit, _State(store, "entries"))
    report(Event("done", "entries", n))
    return n


def _export(store: Store, fetch: Callable[[str, int], str], kind: str, take: Callable[[str], int], report: Reporter) -> int:
    """Pages of the comment export from the first id not yet read; ``take`` stores a landed page and gives the highest id on it, 0 for none."""
    state, total = _State(store, kind), 0
    while True:
        start = state.get("from", 0)
        path = f"{store.root}/landing/{kind}-{start}.xml"
        files.put(store.spark, path, fetch(kind, start))
        top = take(path)
        if top < start or not top:
            return total
        total += 1
        state["from"] = top + 1
        report(Event("tick", kind, top))


def sync_comments(store: Store, fetch: Callable[[str, int], str], report: Reporter = silent) -> None:
    """``fetch(kind, start)`` gives a page of the export as XML, kind comment_meta or comment_body.

    The index names posters and all comments; bodies fill in the rest. A comment of which only the index is read is no row yet.
    """
    spark = store.spark
    report(Event("start", "comments"))

    def index(path: str) -> int:
        store.upsert("users", comments.posters(spark, path).where("posterid is not null and username is not null"))
        return comments.comment_index(spark, path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    def bodies(path: str) -> int:
        rows = comments.comment_bodies(spark, path).where("id is not null and jitemid is not null")
        store.upsert("comments", rows.withColumn("fetched_at", F.lit(_now())))
        return rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    _export(store, fetch, "comment_meta", index, report)
    _export(store, fetch, "comment_body", bodies, report)
    report(Event("done", "comments", store.read("comments").count()))


def sync(store: Store, client: paging.Client, user: str, digest: str, export: Callable[[str, int], str] | None = None, report: Reporter = silent) -> dict[str, int]:
    """Login, entries, and comments where ``export`` is given; returns the rows of each table. Communities are told, never fetched."""
    ask = lambda method, params: _request(client, user, digest, method, params)
    report(Event("start", "login"))
    who = xmlrpc.login_of(ask("login", {"getmoods": 0}))
    if who["moods"]:
        moods = store.spark.createDataFrame(who["moods"], TABLES["moods"][0])
        store.upsert("moods", moods)
    store.set_state("username", who["username"] or user)
    report(Event("done", "login", len(who["moods"]), "moods"))
    if who["usejournals"]:
        report(Event("note", text=f"{len(who['usejournals'])} communities are visible and not archived"))
    sync_entries(store, ask, report)
    if export:
        sync_comments(store, export, report)
        store.check()
    return {name: store.read(name).count() for name in ("entries", "comments", "users", "moods")}
