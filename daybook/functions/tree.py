"""Tag soup to a tree: open elements, implied ends, misplaced table content, crossing formatting elements."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

from daybook.functions.markup import tokens

#: Elements of HTML by what they do to those around them.
VOID = set("area base br col embed hr img input link meta param source track wbr lj lj-user".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = set("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li listing main menu nav ol p pre section summary table ul xmp".split())
SPECIAL = CLOSES_P | set("applet area body br button caption col colgroup embed frame head html iframe img input link marquee meta noscript object script select source style tbody td template textarea tfoot th thead title tr track wbr lj-cut".split())
#: Beyond these an end tag or a search for an open element does not look.
FENCES = set("applet button caption html marquee object table td template th".split())
#: What may stand where in a table, with the elements that must be opened first.
IN_TABLE = {"table": {"caption", "colgroup", "thead", "tbody", "tfoot"}, "tbody": {"tr"}, "thead": {"tr"}, "tfoot": {"tr"}, "tr": {"td", "th"}, "colgroup": {"col"}}
MISSING = {"table": {"tr": ["tbody"], "td": ["tbody", "tr"], "th": ["tbody", "tr"], "col": ["colgroup"]}, "tbody": {"td": ["tr"], "th": ["tr"]}}
MISSING |= {"thead": MISSING["tbody"], "tfoot": MISSING["tbody"]}
PARTS = set("caption colgroup col thead tbody tfoot tr td th".split())
SILENT = set("script style template".split())
#: Elements that may be open in each other, and formatting that may be waiting to go on: deeper ones stand beside each other, so that no soup costs the square of its length.
DEEPEST, WAITING = 256, 64


@dataclass(eq=False)
class Element:
    name: str
    attributes: list[tuple[str, str]] = field(default_factory=list)
    children: list[Element | str] = field(default_factory=list)
    parent: Element | None = None

    def append(self, child: Element | str, before: Element | None = None) -> None:
        at = next(i for i, c in enumerate(self.children) if c is before) if before is not None else len(self.children)
        if isinstance(child, Element):
            child.detach()
            child.parent = self
        elif at and isinstance(self.children[at - 1], str):
            self.children[at - 1] += child
            return
        self.children.insert(at, child)

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class Builder:
    """Puts one token after the other into a tree below ``root``."""

    def __init__(self):
        self.root = Element("")
        self.open: list[Element] = [self.root]
        self.formatting: list[Element | None] = []  # None: the start of a cell, a caption or an object, which formatting does not enter

    def place(self, node: Element | str) -> None:
        """At the end of the innermost open element; before the table, if that is where only rows or cells may stand."""
        top = self.open[-1]
        if top.name in IN_TABLE and top.name != "colgroup" and not (isinstance(node, Element) and (node.name in IN_TABLE[top.name] or node.name in SILENT)) and (isinstance(node, Element) or node.strip()):
            table = next(e for e in reversed(self.open) if e.name == "table" or e is self.root)
            if table.parent is not None:
                table.parent.append(node, before=table)
                return
        top.append(node)

    def push(self, name: str, attributes: list[tuple[str, str]]) -> Element:
        if len(self.open) > DEEPEST:
            self.pop_to(self.open[-1])
        new = Element(name, attributes)
        self.place(new)
        self.open.append(new)
        return new

    def find(self, names: set[str], fences: set[str] = FENCES) -> Element | None:
        for e in reversed(self.open[1:]):
            if e.name in names:
                return e
            if e.name in fences:
                return None
        return None

    def pop_to(self, e: Element) -> None:
        at = self.open.index(e)
        if any(x.name in ("td", "th", "caption", "object", "applet", "marquee") for x in self.open[at:]) and None in self.formatting:
            self.formatting = self.formatting[: len(self.formatting) - 1 - self.formatting[::-1].index(None)]
        del self.open[at:]

    def reopen(self) -> None:
        """Formatting that a block's end closed goes on in what comes next."""
        first = len(self.formatting)
        while first and self.formatting[first - 1] is not None and self.formatting[first - 1] not in self.open:
            first -= 1
        for i in range(first, len(self.formatting)):
            old = self.formatting[i]
            self.formatting[i] = self.push(old.name, list(old.attributes))

    def start(self, name: str, attributes: list[tuple[str, str]], empty: bool = False) -> None:
        top = self.open[-1]
        if name in ("html", "head", "body"):
            return
        if name in PARTS and (table := self.find({"table"}, {"template"})) is not None:
            if top.name not in IN_TABLE:  # a cell, or soup: closed up to what the new part belongs into
                at = next(e for e in reversed(self.open) if e is table or e.name in IN_TABLE)
                self.pop_to(self.open[self.open.index(at) + 1])
            while self.open[-1] is not table and name not in IN_TABLE[self.open[-1].name] and name not in MISSING.get(self.open[-1].name, {}):
                self.open.pop()
            for part in MISSING.get(self.open[-1].name, {}).get(name, []):
                self.push(part, [])
            self.push(name, attributes)
            if name == "col":
                self.open.pop()
            if name in ("td", "th", "caption"):
                self.formatting.append(None)
            return
        if name in PARTS:
            return  # a part of no table: its content stays
        if name == "table" and top.name in IN_TABLE and (table := self.find({"table"}, {"template"})):
            self.pop_to(table)
        if name in CLOSES_P and (p := self.find({"p"})) is not None:
            self.pop_to(p)
        for own, fences in (({"li"}, FENCES | {"ol", "ul"}), ({"dd", "dt"}, FENCES | {"dl"}), ({"option"}, FENCES | {"select"})):
            if name in own and (e := self.find(own, fences)) is not None:
                self.pop_to(e)
        if name in ("a", "nobr") and (e := self.find({name})) is not None:
            self.adopt(e)
        if name not in SPECIAL or name in ("br", "img", "input", "embed", "object", "button", "select", "textarea", "iframe"):
            self.reopen()
        new = self.push(name, attributes)
        if name in VOID or empty and name.startswith("lj"):
            self.open.pop()
        elif name in FORMATTING:
            self.formatting = [*self.formatting[-WAITING:], new]
        elif name in ("object", "applet", "marquee"):
            self.formatting.append(None)

    def end(self, name: str) -> None:
        if name in VOID or name in ("html", "head", "body"):
            if name == "br":
                self.start("br", [])
            return
        if name in FORMATTING:
            if (e := self.find({name})) is not None:
                self.adopt(e)
        elif name in PARTS or name == "table":
            if (e := self.find({name}, {"table", "template"} - {name})) is not None:
                self.pop_to(e)
        elif name == "p" and self.find({"p"}) is None:
            self.start("p", [])
            self.open.pop()
        elif (e := self.find({name}, FENCES if name in SPECIAL else SPECIAL)) is not None:
            self.pop_to(e)

    def text(self, text: str) -> None:
        if text:
            if text.strip():
                self.reopen()
            self.place(text)

    def adopt(self, e: Element) -> None:
        """The end of formatting that other elements have been opened in since: blocks among them get a copy of it around what they hold so far."""
        inside = self.open[self.open.index(e) + 1 :]
        block = next((x for x in inside if x.name in SPECIAL), None)
        if block is None:
            del self.open[self.open.index(e) :]
            self.formatting = [x for x in self.formatting if x is not e]
            return
        between = inside[: inside.index(block)]
        last: Element = block
        for x in reversed(between):  # formatting between the two is split as well
            if x not in self.formatting:
                self.open.remove(x)
                continue
            copy = Element(x.name, list(x.attributes))
            self.formatting[self.formatting.index(x)] = copy
            self.open[self.open.index(x)] = copy
            copy.append(last)
            last = copy
        above = self.open[self.open.index(e) - 1]
        (e.parent or above).append(last, before=self._behind(e))
        copy = Element(e.name, list(e.attributes))
        for c in list(block.children):
            if isinstance(c, Element):
                copy.append(c)
            else:
                copy.children.append(c)
        block.children = []
        block.append(copy)
        self.open.remove(e)
        self.formatting = [x for x in self.formatting if x is not e]
        # what the block held stands in the copy, which is closed: what comes next is not formatted by it

    @staticmethod
    def _behind(e: Element) -> Element | None:
        siblings = e.parent.children if e.parent is not None else []
        after = siblings[next((i for i, c in enumerate(siblings) if c is e), len(siblings)) + 1 :]
        return next((c for c in after if isinstance(c, Element)), None) if after and isinstance(after[0], Element) else None


def tree(source: str) -> Element:
    """The root of a fragment's tree. A tag that is cut off at the end is none."""
    b = Builder()
    for t in tokens(source):
        if t.kind in ("open", "close") and not source.endswith(">", 0, t.at[1]):
            continue
        if t.kind == "open":
            b.start(t.name, list({a.name: a.value for a in reversed(t.attributes)}.items())[::-1], t.empty)
        elif t.kind == "close":
            b.end(t.name)
        elif t.kind == "text":
            b.text(unescape(source[slice(*t.inside)]))
        elif t.kind == "raw":
            inside = source[slice(*t.inside)]
            b.open[-1].append(unescape(inside) if t.name in ("title", "textarea") else inside)
    return b.root


def walk(root: Element) -> Iterator[tuple[str, Element | str]]:
    """(start, element), (end, element) and (text, string) in the order of the document; trees of any depth."""
    stack: list[tuple[Element, int]] = [(root, 0)]
    while stack:
        e, i = stack.pop()
        if i == len(e.children):
            if e is not root:
                yield "end", e
            continue
        stack.append((e, i + 1))
        child = e.children[i]
        if isinstance(child, str):
            yield "text", child
        else:
            yield "start", child
            stack.append((child, 0))


def outline(source: str) -> str:
    """The tree as text, for tests: elements without attributes and what they hold."""
    return "".join(x if kind == "text" else f"<{x.name}>" if kind == "start" else "" if x.name in VOID else f"</{x.name}>" for kind, x in walk(tree(source)))
