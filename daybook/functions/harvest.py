"""What a rendered page shows and the export lacks: pictures, frames, and the text as it was displayed."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions.html import VOID
from daybook.functions.lazy import arrow_udf

#: Addresses of pictures (picture, user) and ids of comments on rendered pages.
PICTURE = re.compile(r"l-userpic\.livejournal\.com/(\d+)/(\d+)")
COMMENT = re.compile(r"ljcmt(\d+)")
HARVEST = (
    "entry struct<picid:bigint,userid:bigint,url:string>, comments array<struct<comment_id:bigint,picid:bigint,userid:bigint,url:string>>, "
    "frames array<string>, text string, breaks int"
)


class _Harvester(HTMLParser):
    """Keeps the open elements with the part of the page each one begins, and how often each part is open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, set]] = []
        self.parts: dict = {}
        self.entry, self.first_pic, self.body, self.bodies = None, True, [], 0
        self.comments, self.decided, self.frames, self.breaks = [], set(), [], 0

    def inside(self, *parts) -> bool:
        return all(self.parts.get(p) for p in parts)

    def in_body(self) -> bool:
        return self.inside("body") and not self.inside("tags")

    def begins(self, tag: str, a: dict) -> set:
        classes, found = set(a.get("class", "").split()), set()
        if tag == "div" and "entry_text" in classes:
            found.add("any body")
            self.bodies += 1
            if self.bodies == 1:
                found.add("body")
        if tag == "div" and "ljtags" in classes:
            found.add("tags")
        found |= classes & {"subcontent"}
        if "userpicfriends" in classes and self.inside("subcontent"):
            found.add("entry picture")
        m = COMMENT.fullmatch(a.get("id", ""))
        return found | ({int(m[1]) >> 8} if m else set())

    def picture(self, a: dict) -> None:
        m = PICTURE.search(a.get("src", ""))
        if self.inside("entry picture") and self.first_pic:
            self.first_pic = False
            if m:
                self.entry = {"picid": int(m[1]), "userid": int(m[2]), "url": a["src"]}
        if "userpiccomment" in a.get("class", "").split():
            for c in [p for p, n in self.parts.items() if isinstance(p, int) and n and p not in self.decided]:
                self.decided.add(c)
                if m:
                    self.comments.append({"comment_id": c, "picid": int(m[1]), "userid": int(m[2]), "url": a["src"]})

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "img":
            self.picture(a)
        elif tag == "iframe" and self.inside("any body") and a.get("src"):
            self.frames.append(a["src"])
        elif tag == "br" and self.in_body():
            self.breaks += 1
        if tag not in VOID:
            begun = self.begins(tag, a)
            self.open.append((tag, begun))
            for p in begun:
                self.parts[p] = self.parts.get(p, 0) + 1

    def handle_startendtag(self, tag, attrs):
        # a slash at the end means nothing but on void elements
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            last = None
            while last != tag:
                last, begun = self.open.pop()
                for p in begun:
                    self.parts[p] -= 1

    def handle_data(self, data):
        if self.in_body():
            self.body.append(data)


def harvest(html: str | None) -> dict:
    """Text and breaks are those of the first body without its tags; null where the page shows none."""
    h = _Harvester()
    h.feed(html or "")
    h.close()
    return {"entry": h.entry, "comments": h.comments, "frames": h.frames, "text": "".join(h.body) if h.bodies else None, "breaks": h.breaks if h.bodies else None}


@arrow_udf(HARVEST)
def harvest_udf(html: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([harvest(x) for x in html], columns=["entry", "comments", "frames", "text", "breaks"])
    return out.astype({"breaks": "Int32"})


def stream(text: Column) -> Column:
    """Letters and digits alone, lower-cased: what two renderings of one text share."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
