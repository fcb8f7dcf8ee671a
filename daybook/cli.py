"""Command line: fetch, images, userpics, video-posters, build, status. Exit codes: 2 something is missing, 3 the server banned us, 1 anything else."""

from __future__ import annotations

import argparse
import os
import sys

from daybook.sources.paging import Banned


class Secret:
    """A value that never prints itself."""

    def __init__(self, value: str):
        self._value = value

    def reveal(self) -> str:
        return self._value

    def __repr__(self) -> str:
        return "Secret(***)"

    __str__ = __repr__

    def __reduce__(self):
        raise TypeError("a secret is not sent anywhere")


def status(store) -> dict[str, int]:
    return {name: store.read(name).count() for name in ("entries", "comments", "users", "assets")}


def build(spark, store, root: str, base: str | None = None) -> int:
    """Writes the site: entries with their comments, all lists and their indexes, calendars, pictures, the dashboard, the home page."""
    from daybook.operators.archive import Archive
    from daybook.plans import site

    if not store.read("entries").take(1):
        print("nothing to build: the archive is empty", file=sys.stderr)
        return 2
    store.check()
    tables = {name: store.read(name) for name in store.tables}
    me = store.get_state("username")
    base = base or (f"https://{me.replace('_', '-')}.livejournal.com" if me else "")
    site.start(root)
    told = status(store) | {"pages": sum(site.write_files(pages, root) for pages in site.all_pages(Archive(tables, me, base)))}
    print(", ".join(f"{n} {name}" for name, n in told.items()), file=sys.stderr)
    return 0


def send_to(server: str, cookie: str = ""):
    """body -> (status, text) of a request to the server."""

    def send(body: str) -> tuple[int, str]:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(server, body.encode(), {"Content-Type": "text/xml"} | ({"Cookie": cookie} if cookie else {})), timeout=60) as r:
                return r.status, r.read().decode("utf-8", "replace")
        except HTTPError as e:
            return e.code, ""

    return send


def get(url: str) -> tuple[int, bytes]:
    """(status, content) of an address of the web; anything else, say a file, is refused."""
    from urllib.error import HTTPError
    from urllib.request import urlopen

    if not url.lower().startswith(("http://", "https://")):
        raise OSError("not an address of the web")
    try:
        with urlopen(url, timeout=20) as r:
            return r.status, r.read()
    except HTTPError as e:
        return e.code, b""


COMMANDS = ["fetch", "images", "userpics", "video-posters", "classify", "build", "status"]


def run(a, spark, send=None, get=get) -> int:
    """One command; ``send`` and ``get`` stand for the network."""
    from datetime import datetime, timezone

    from daybook.operators import localize
    from daybook.operators.store import Store
    from daybook.progress import to_stderr
    from daybook.sources.paging import Client
    from daybook.sources.sync import sync

    store, now = Store(spark, a.store), datetime.now(timezone.utc).isoformat()
    if a.command == "fetch":
        digest = Secret(os.environ.get("DAYBOOK_MD5", ""))
        if not a.user or not digest.reveal() or not (a.server or send):
            print("needs --server, --user and the password's MD5 in DAYBOOK_MD5", file=sys.stderr)
            return 2
        told = sync(store, Client(send or send_to(a.server), spacing=a.delay), a.user, digest.reveal(), report=to_stderr)
    elif a.command == "status":
        told = status(store)
    elif a.command == "build":
        return build(spark, store, a.out, a.base)
    elif not store.read("entries").take(1):
        print("nothing fetched yet", file=sys.stderr)
        return 2
    elif a.command == "images":
        base = a.base or (f"https://{user.replace('_', '-')}.livejournal.com" if (user := a.user or store.get_state("username")) else None)
        if not base:
            print("needs --base or --user to resolve relative addresses", file=sys.stderr)
            return 2
        told = localize.images(store, base, get, a.out, now, to_stderr)
    else:
        told = (localize.userpics if a.command == "userpics" else localize.video_posters)(store, get, a.out, now, to_stderr)
    for name, n in told.items():
        print(f"{name}\t{n}")
    return 0


def main(argv: list[str] | None = None, spark=None, send=None, get=get) -> int:
    p = argparse.ArgumentParser("daybook")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--store", required=True)
    p.add_argument("--out", default="site")
    p.add_argument("--server")
    p.add_argument("--user")
    p.add_argument("--base", help="address against which relative ones resolve")
    p.add_argument("--delay", type=float, default=2.0, help="seconds between requests")
    a = p.parse_args(argv)
    if a.command == "classify":
        print("not implemented", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.builder.appName("daybook").getOrCreate()
    try:
        return run(a, spark, send, get)
    except Banned:
        return 3
    except Exception as e:  # noqa: BLE001 - the exit code is the contract
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
