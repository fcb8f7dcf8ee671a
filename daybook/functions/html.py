"""Tag-soup HTML: extraction of references, rendering, redaction. Parsing needs Python; it runs as Arrow-batched UDFs."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from itertools import groupby
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions import redact as redact_lists
from daybook.functions.lazy import arrow_udf
from daybook.functions.redact import redact, redact_udf  # noqa: F401
from daybook.functions.tree import VOID, tree, walk

EMBEDS = ("iframe", "object", "embed", "video", "lj-embed")
#: Elements inside which a line break in the source is no break on the page.
NO_BREAKS = {"table", "pre", "select", "textarea", "script", "style"}
IMAGE = re.compile(r"\.(?:jpe?g|png|gif|bmp|webp|tiff?)(?:[?#]|$)", re.I)


def whole(html: str | None) -> str:
    """The input without an unfinished tag at its end and with '</' that starts no tag as text."""
    text = re.sub(r"</(?![A-Za-z])", "&lt;/", html or "")
    at = text.rfind("<")
    return text[:at] if at >= 0 and ">" not in text[at:] and re.match(r"</?[A-Za-z]", text[at:]) else text


def resolve(raw: str, base: str | None = None) -> str:
    """An absolute address by the base, with unsafe signs quoted; what can't be parsed comes back trimmed."""
    raw = raw.strip()
    try:
        full = urljoin(base or "", raw)
        urlsplit(full)
    except ValueError:
        return raw
    return quote(full, safe="%/:=&?~#+!$,;'@()*[]-._")


class _Extractor(HTMLParser):
    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.base, self.images, self.users, self.embeds, self.links = base, [], [], [], []
        self.cut, self.cut_text, self.muted = False, None, 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style"):
            self.muted += 1
        elif tag == "img" and a.get("src", "").strip():
            self.images.append((resolve(a["src"], self.base), a["src"], a.get("alt"), "img"))
        elif tag == "a" and a.get("href", "").strip():
            self.links.append(resolve(a["href"], self.base))
            if IMAGE.search(a["href"]):
                self.images.append((resolve(a["href"], self.base), a["href"], None, "link"))
        elif tag in ("lj", "lj-user") and (a.get("user") or a.get("comm")):
            self.users.append((a.get("user") or a["comm"]).lower())
        elif tag == "lj-cut":
            if not self.cut:
                self.cut, self.cut_text = True, a.get("text")
        if tag in EMBEDS:
            self.embeds.append((tag, a.get("src") or a.get("data") or a.get("id")))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.muted = max(0, self.muted - 1)


def extract(html: str | None, base: str | None = None) -> dict:
    p = _Extractor(base)
    p.feed(whole(html))
    p.close()
    return {
        "images": [dict(zip(("url", "raw", "alt", "kind"), x)) for x in p.images],
        "users": p.users,
        "embeds": [{"tag": t, "url": u} for t, u in p.embeds],
        "links": p.links,
        "has_cut": p.cut,
        "cut_text": p.cut_text,
    }


EXTRACTION = "images array<struct<url:string,raw:string,alt:string,kind:string>>, users array<string>, embeds array<struct<tag:string,url:string>>, links array<string>, has_cut boolean, cut_text string"


@arrow_udf(EXTRACTION)
def extract_udf(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(h, b) for h, b in zip(html, base)], columns=["images", "users", "embeds", "links", "has_cut", "cut_text"])


@arrow_udf("string")
def resolve_udf(raw: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else resolve(r, b) for r, b in zip(raw, base)])


#: What a page of the archive may hold; other elements go, what they hold stays. Beside ``class`` and ``id``, attributes of these only.
KEPT_ELEMENTS = set(
    "a abbr acronym address article aside b bdi bdo big blockquote br button caption center cite code col colgroup dd del details dfn dir div dl dt em fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 header hr i img input ins "
    "kbd label legend li main mark marquee nav nobr ol optgroup option p pre q rp rt ruby s samp section select small span strike strong sub summary sup table tbody td textarea tfoot th thead time tr tt u ul var wbr xmp".split()
)
KEPT_ATTRIBUTES = redact_lists.STRUCTURE - {"charset"} | {"href", "src", "action", "cite", "background", "alt", "title", "value", "name", "label", "summary", "for", "open", "style"}
SCHEMES = {"http", "https", "ftp", "mailto"}


def safe_address(value: str) -> bool:
    """A relative address or one of ``SCHEMES``; signs that browsers pass over don't hide another."""
    bare = re.sub(r"[\x00-\x20\x7f-\xa0\xad\u200b-\u200f\u2028-\u202f\ufeff]+", "", value).lower()
    m = re.match(r"([^/?#]*?):", bare)
    return m is None or m[1] in SCHEMES or bool(re.fullmatch(r"[a-z0-9-]+(\.[a-z0-9-]+)+", m[1])) and bool(re.match(r"\d*([/?#]|$)", bare[m.end() :]))


class _Renderer:
    """Writes safe HTML of a tree: scripts and handlers go, images become local files or marks, journal tags become plain HTML."""

    def __init__(self, live: dict, dead: dict, held: dict, host: str, root: str, preformatted: bool, posters: list, users: str):
        self.live, self.dead, self.held, self.host, self.root, self.users = live, dead, held, host, root, users
        self.pre, self.posters, self.embed_no = preformatted, posters, 0
        self.out, self.muted, self.quiet, self.swallow = [], 0, 0, 0

    def of(self, source: str) -> str:
        for kind, x in walk(tree(source)):
            if kind == "text":
                self.text(x)
            elif kind == "start":
                self.start(x.name, x.attributes)
            else:
                self.end(x.name)
        return "".join(self.out)

    def mark(self, kind: str, label: str, title: str = "") -> None:
        extra = f' title="{escape(title)}"' if title else ""
        self.out.append(f'<span class="lost lost-{kind}"{extra}>{escape(label)}</span>')

    def clean(self, attrs) -> list[tuple[str, str]]:
        kept = [(k, v) for k, v in attrs if k in KEPT_ATTRIBUTES and (k not in redact_lists.ADDRESSES or safe_address(v))]
        return [(k, v) for k, v in kept if k != "style" or not re.search(r"(?i)url\s*\(|expression|@import|behavior|\\\\|/\*|position\s*:", v)]

    def tag(self, name: str, attrs) -> None:
        self.out.append("<" + name + "".join(f' {k}="{escape(v)}"' for k, v in attrs) + ">")

    def image(self, a: dict) -> None:
        url = resolve(a.get("src", ""))
        if url in self.live:
            self.tag("img", [("src", self.root + self.live[url]), ("loading", "lazy"), ("alt", a.get("alt", ""))])
        else:
            self.mark("image", a.get("alt") or "image lost", f"{url} {self.dead.get(url, '')}".strip())

    def link(self, attrs) -> None:
        a, rest = dict(attrs), [(k, v) for k, v in attrs if k not in ("href", "rel")]
        href = a.get("href", "")
        if re.match(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+([/?#:]|$)", href):
            href = "http://" + href
        own = re.fullmatch(r"https?://([^/?#]+)/(\d+)\.html(?:[?#].*)?", href, re.I)
        if own and own[1].lower() == self.host and int(own[2]) in self.held:
            href = f"{self.root}entries/{own[2]}.html"
        elif resolve(href) in self.live:
            href = self.root + self.live[resolve(href)]
        rel = [("rel", "noopener noreferrer")] if a.get("target") == "_blank" else []
        self.tag("a", ([("href", href)] if href else []) + rest + rel)

    def embed(self, tag: str, a: dict) -> None:
        """Posters are those of the journal's own embeds, by their number among themselves."""
        poster = None
        if tag == "lj-embed":
            poster = self.posters[self.embed_no] if self.embed_no < len(self.posters) else None
            self.embed_no += 1
        if poster and safe_address(poster):
            self.out.append(f'<a class="video" href="{escape(poster)}">Watch</a>')
        else:
            self.mark("embed", "embedded media", a.get("src") or a.get("data") or a.get("id") or "")

    def start(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        self.muted += tag in ("script", "style")
        if self.muted or self.swallow and tag not in ("object", "iframe"):
            return
        attrs, a = self.clean(attributes), dict(attributes)
        if tag == "img":
            self.image(a)
        elif tag == "a":
            self.link(attrs)
        elif tag in ("lj", "lj-user"):
            name = a.get("user") or a.get("comm") or a.get("title", "")
            where = self.users.replace("{}", quote(name.lower().replace("_", "-"), safe="-"))
            self.tag("a", [("class", "user"), ("href", where)])
            self.out.append(escape(name) + "</a>")
        elif tag == "lj-cut":
            self.out.append(f"<details open><summary>{escape(a.get('text') or 'Read more')}</summary>")
        elif tag in EMBEDS:
            if not self.swallow:
                self.embed(tag, a)
            self.swallow += tag in ("object", "iframe")
        elif tag.startswith("lj-"):
            if tag != "lj-raw":
                poll = re.fullmatch(r"lj-poll-(\d+)", tag)
                self.mark("tag", f"poll {poll[1]}" if poll else tag[3:])
        elif tag in KEPT_ELEMENTS:
            self.tag(tag, attrs)
        self.quiet += tag in NO_BREAKS

    def end(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.muted -= 1
        elif not self.muted and tag in ("object", "iframe"):
            self.swallow -= 1
        elif not self.muted and not self.swallow:
            self.quiet -= tag in NO_BREAKS
            if tag == "lj-cut":
                self.out.append("</details>")
            elif tag in KEPT_ELEMENTS and tag not in VOID and tag != "img":
                self.out.append(f"</{tag}>")

    def text(self, data: str) -> None:
        if not self.muted and not self.swallow:
            text = escape(data, quote=False)
            self.out.append(text if self.pre or self.quiet else re.sub(r"\r?\n", "<br>\n", text))


def render(html, live=None, dead=None, held=(), host="", root="", preformatted=False, posters=(), users="https://{}.livejournal.com/") -> str:
    """Safe HTML of a body. ``users`` is where a mentioned user's journal is, with {} for the name; posters belong to the journal's embeds in their order."""
    return _Renderer(dict(live or {}), dict(dead or {}), set(held), host.lower(), root, preformatted, list(posters), users).of(html or "")


def render_column(html: Column, live: Column, dead: Column, held: Column, host: Column, preformatted: Column, posters: Column | None = None, users: str = "https://{}.livejournal.com/", root: str = "../") -> Column:
    """The rendered body; what it needs comes as data columns: maps of addresses, an array of held items, an array of posters (null where there is none)."""

    @arrow_udf("string")
    def run(h: pd.Series, a: pd.Series, d: pd.Series, k: pd.Series, o: pd.Series, p: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([render(x, b, c, e if e is not None else (), f or "", root, bool(g), w if w is not None else (), users) for x, b, c, e, f, g, w in zip(h, a, d, k, o, p, v)])

    return run(html, live, dead, held, host, preformatted, posters if posters is not None else F.array().cast("array<string>"))


def not_in_order(a: str, b: str) -> Iterator[bool]:
    """For each character of a, whether b lacks it behind those matched so far."""
    places: dict[str, list[int]] = {}
    for i, ch in enumerate(b):
        places.setdefault(ch, []).append(i)
    start = 0
    for ch in a:
        where = places.get(ch, [])
        k = bisect_left(where, start)
        yield k == len(where)
        if k < len(where):
            start = where[k] + 1


def missing_run(a: str | None, b: str | None) -> int:
    """The longest run of a's characters that a greedy walk through b doesn't find in order."""
    runs = (sum(1 for _ in run) for lost, run in groupby(not_in_order(a or "", b or "")) if lost)
    return max(runs, default=0)


@arrow_udf("int")
def missing_run_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([missing_run(x, y) for x, y in zip(a, b)])
