"""Redaction of tag soup and XML: what may be personal changes, structure and every other byte stay. What no list names is hidden."""

from __future__ import annotations

import base64
import hashlib
import hmac
import re
from html import unescape

import pandas as pd
from pyspark.sql import Column

from daybook.functions.lazy import arrow_udf
from daybook.functions.markup import Attribute, Token, masked, spliced, tokens

#: Names of HTML. Elements that may be seen (those that begin with lj are too), attributes that are structure, addresses or users, and others that are known.
ELEMENTS = set(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed "
    "fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noembed noframes noscript object "
    "ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr xmp".split()
)
STRUCTURE = set("class id width height border align valign cellpadding cellspacing colspan rowspan size color face bgcolor type target rel hspace vspace nowrap dir lang start clear charset checked selected disabled".split())
ADDRESSES = set("href src action formaction background lowsrc poster data cite longdesc usemap codebase srcset xlink:href profile manifest".split())
USERS = {"user", "comm"}
OTHERS = set("alt title value name content label summary text style placeholder http-equiv for media frameborder scrolling allowfullscreen allowscriptaccess wmode flashvars loop autoplay controls onclick onload onerror onmouseover".split())
#: Endings of addresses that say what kind of file it is.
ENDING = re.compile(r"\.(?:jpe?g|png|gif|bmp|webp|tiff?|html?|xml|css|js|swf|mp3|mp4)(?=[?#]|$)", re.I)


def pseudonym(name: str, salt: str) -> str:
    """The same for a name wherever it is met, without a table of names; not to be guessed without the salt."""
    return "u" + hmac.new(salt.encode(), name.encode(), hashlib.sha256).hexdigest()[:12]


def masked_address(raw: str) -> str:
    """An address with its scheme, separators and ending; all other letters and digits are hidden."""
    head = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?", raw)[0]
    if not re.match(r"\s*(?:https?|ftp|mailto|file|data|javascript):$", head, re.I):
        head = ""
    end = ENDING.search(raw, len(head))
    if end is None:
        return head + masked(raw[len(head) :])
    return head + masked(raw[len(head) : end.start()]) + end[0] + masked(raw[end.end() :])


def _hidden(a: Attribute, source: str, salt: str) -> str:
    raw = source[a.at[0] : a.at[1]]
    if not raw.strip() or a.name in STRUCTURE:
        return raw
    if a.name in USERS:
        return pseudonym(a.value.lower(), salt)
    return masked_address(raw) if a.name in ADDRESSES else "x"


def _name(name: str, raw: str, known: set[str], *starts: str) -> str:
    """A name that no list has is hidden: in soup, text stands where names should."""
    return raw if name in known or any(re.fullmatch(rf"{s}[a-z-]*[0-9]*", name) for s in starts) else masked(raw)


def redact(html: str | None, salt: str = "") -> tuple[str, list[str]]:
    """(the source with words, numbers, unlisted names and attribute values replaced, what was removed, as it stood there)."""
    source, cuts = html or "", []
    for t in tokens(source):
        if t.kind in ("open", "close"):
            at = t.at[0] + 1 + (t.kind == "close")
            cuts.append((at, at + len(t.name), _name(t.name, source[at : at + len(t.name)], ELEMENTS, "lj-?")))
            for a in t.attributes:
                cuts.append((*a.name_at, _name(a.name, source[slice(*a.name_at)], STRUCTURE | ADDRESSES | USERS | OTHERS)))
                cuts.append((*a.at, _hidden(a, source, salt)))
        else:
            inside = source[slice(*t.inside)]
            known = re.match(r"doctype\s+html\b", inside, re.I) if t.kind == "declaration" else None
            skip = known.end() if known else 0
            # word by word, so that what was removed are words
            start = t.inside[0] + skip
            cuts += [(start + m.start(), start + m.end(), masked(m[0])) for m in re.finditer(r"[^\s<>]+", inside[skip:])]
    return spliced(source, cuts)


def words_of(removed: list[str]) -> list[str]:
    """What was removed, read: references and percent signs decoded, and the words and numbers in it."""
    from urllib.parse import unquote

    out: dict[str, None] = {}
    for value in removed:
        for read in dict.fromkeys((value, unescape(value), unquote(unescape(value)))):
            out |= dict.fromkeys([read.strip(), *re.findall(r"[^\W_]+", read)])
    return [v for v in out if any(c.isalnum() for c in v)]


@arrow_udf("html string, removed array<string>")
def redact_udf(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if h is None else (lambda r: (r[0], words_of(r[1])))(redact(h)) for h in html], columns=["html", "removed"])


class Rules:
    """What XML hides: the text of ``elements`` and of ``members`` (a name element beside a value), each by a fixed text or, where that is None, by masking what it says as HTML; attributes named in ``names`` by pseudonyms.

    Text in CDATA, in a value with or without a type, and in base64 is all the same. A member that is named here and holds
    anything but text is an error, since nothing says how to hide it.
    """

    def __init__(self, elements: dict[str, str | None] | None = None, members: dict[str, str | None] | None = None, names: tuple[str, ...] = (), salt: str = ""):
        self.elements, self.members, self.names, self.salt = elements or {}, members or {}, names, salt

    def apply(self, xml: str) -> tuple[str, list[str]]:
        """(the document, what was removed, decoded)."""
        removed: list[str] = []
        cuts: list[tuple[int, int, str]] = []
        path: list[str] = []
        member: list[str | None] = [None]
        for t in tokens(xml, xml=True):
            if t.kind == "open":
                for a in t.attributes:
                    if a.name in self.names and a.value:
                        removed.append(a.value)
                        cuts.append((*a.at, pseudonym(a.value, self.salt)))
                if t.empty:
                    continue
                path.append(t.name)
                if t.name == "member":
                    member.append(None)
                elif t.name in ("struct", "array", "data") and member[-1] in self.members:
                    raise ValueError(f"the member {member[-1]!r} holds more than text")
            elif t.kind == "close":
                while path and path.pop() != t.name:
                    pass
                if t.name == "member" and len(member) > 1:
                    member.pop()
            elif t.kind in ("text", "cdata"):
                inside = xml[slice(*t.inside)]
                if path[-1:] == ["name"] and "member" in path[-2:]:
                    member[-1] = (unescape(inside) if t.kind == "text" else inside).strip()
                elif inside.strip():
                    self._text(t, inside, path, member[-1], cuts, removed)
            elif t.kind == "comment":
                put = masked(xml[slice(*t.inside)])
                removed.append(xml[slice(*t.inside)])
                cuts.append((*t.inside, put))
        return spliced(xml, cuts)[0], [r for r in removed if any(c.isalnum() for c in r)]

    def _text(self, t: Token, inside: str, path: list[str], member: str | None, cuts: list, removed: list[str]) -> None:
        within = next((e for e in reversed(path) if e in self.elements), None)
        if member in self.members and "value" in path:
            put = self.members[member]
        elif within is not None:
            put = self.elements[within]
        else:
            return
        plain = inside if t.kind == "cdata" else unescape(inside)
        coded = path[-1:] == ["base64"]
        if coded:
            plain = base64.b64decode(plain).decode("utf-8", "replace")
        out, gone = (put, [plain]) if put is not None else redact(plain, self.salt)
        removed += words_of(gone)
        if coded:
            out = base64.b64encode(out.encode()).decode()
        elif t.kind == "text":
            out = out.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        cuts.append((*t.inside, out.replace("]]>", "]] >") if t.kind == "cdata" else out))


#: The personal parts of the comment export and of event responses: texts are masked, what is a single value is left out.
COMMENTS = Rules(elements={"body": None, "subject": None}, names=("user",))
EVENTS = Rules(members={name: None for name in ("event", "subject", "taglist", "current_mood", "current_music", "current_location")} | {"url": "https://xxxx.xx/0"})


def redact_xml(xml: Column, rules: Rules, salt: str = "") -> Column:
    """xml, removed of each document; null stays null. ``scrub.leaks`` over both tells whether anything removed is left anywhere."""
    own = Rules(rules.elements, rules.members, rules.names, salt or rules.salt)

    @arrow_udf("xml string, removed array<string>")
    def run(docs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if d is None else own.apply(d) for d in docs], columns=["xml", "removed"])

    return run(xml)
