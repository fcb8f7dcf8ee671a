"""Markup read by position: every token of tag soup or XML with the places of its parts in the source."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

#: Elements whose content is text up to their end tag.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*(?P<name>[^\s/>=][^\s/>=]*)(?:\s*=\s*(?P<value>\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s>]*))?")
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);?")


@dataclass
class Attribute:
    """name and decoded value, with the places of the name and of the value without its quotes; no value: an empty place."""

    name: str
    value: str
    name_at: tuple[int, int]
    at: tuple[int, int]


@dataclass
class Token:
    """kind is text, raw (text of a RAW element), open, close, comment, cdata or declaration; ``inside`` is what lies between its marks."""

    kind: str
    at: tuple[int, int]
    inside: tuple[int, int]
    name: str = ""
    attributes: list[Attribute] = field(default_factory=list)
    empty: bool = False


def tokens(source: str, xml: bool = False) -> Iterator[Token]:
    """All of the source, token after token. What is cut off at the end still counts; '<' that begins nothing is text. In XML names keep their case and no element is raw."""
    at, text, n = 0, 0, len(source)

    def marked(kind: str, opening: int, closing: str) -> Token:
        end = source.find(closing, at + opening)
        return Token(kind, (at, n if end < 0 else end + len(closing)), (at + opening, n if end < 0 else end))

    while (at := source.find("<", at)) >= 0:
        ahead = source[at + 1 : at + 2]
        if source.startswith("<!--", at):
            token = marked("comment", 4, "-->")
        elif xml and source.startswith("<![CDATA[", at):
            token = marked("cdata", 9, "]]>")
        elif ahead in ("!", "?") and ahead:
            token = marked("declaration", 2, "?>" if xml and ahead == "?" else ">")
        elif re.match(r"</?[A-Za-z_]" if xml else r"</?[A-Za-z]", source[at : at + 3]):
            token = _tag(source, at, xml)
        else:
            at += 1
            continue
        if text < at:
            yield Token("text", (text, at), (text, at))
        yield token
        at = text = token.at[1]
        if token.kind == "open" and token.name in RAW and not xml:
            end = re.compile(rf"</{token.name}(?=[\s/>]|$)", re.I).search(source, at)
            stop = end.start() if end else n
            if at < stop:
                yield Token("raw", (at, stop), (at, stop), token.name)
            at = text = stop
    if text < n:
        yield Token("text", (text, n), (text, n))


def _tag(source: str, start: int, xml: bool) -> Token:
    close = source[start + 1] == "/"
    m = _NAME.match(source, start + 1 + close)
    at, name, found, names = m.end(), m[0] if xml else m[0].lower(), [], set()
    while (m := _ATTRIBUTE.match(source, at)) and m.end() > at:
        key, first, last = m["name"] if xml else m["name"].lower(), *(m.span("value") if m["value"] is not None else (m.end(), m.end()))
        value = source[first:last]
        if value[:1] in ('"', "'"):
            first, last = first + 1, last - (len(value) > 1 and value[-1] == value[0])
        found.append(Attribute(key, unescape(source[first:last]), m.span("name"), (first, last)))
        names.add(key)
        at = m.end()
    m = re.compile(r"[\s/]*").match(source, at)
    end = m.end() + (source[m.end() : m.end() + 1] == ">")
    return Token("close" if close else "open", (start, end), (start, end), name, found, "/" in m[0])


def masked(text: str) -> str:
    """Letters to x, digits to 0, all else as it is; references that stand for such a sign as well."""

    def plain(part: str) -> str:
        return "".join("0" if c.isnumeric() else "x" if c.isalpha() else c for c in part)

    out, at = [], 0
    for m in _REFERENCE.finditer(text):
        read = unescape(m[0])
        out.append(plain(text[at : m.start()]))
        out.append(plain(m[0]) if read == m[0] else plain(read) if any(c.isalnum() for c in read) else m[0])
        at = m.end()
    return "".join([*out, plain(text[at:])])


def spliced(source: str, cuts: list[tuple[int, int, str]]) -> tuple[str, list[str]]:
    """The source with each place (start, end, put) replaced, and what was there, of the places that change."""
    out, removed, at = [], [], 0
    for start, end, put in sorted(cuts):
        if start < at or source[start:end] == put:
            continue
        removed.append(source[start:end])
        out += [source[at:start], put]
        at = end
    return "".join([*out, source[at:]]), removed
