"""HTML pages to zones, by rules that map elements and attributes to fields.

Elements take the field of the innermost rule that matches them or an element around them; elements that separate
words on the page (cells, items, paragraphs ...) separate zones.  Pages are parsed in Arrow batches by the standard
library's parser, which never fails on malformed markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PATH_FIELD
from ..operators.index import SEPARATION, ZONE

APART, NEXT, ATTRIBUTE = 3, 0, 2
_SEPARATING = frozenset(
    "article aside blockquote br button caption dd dt figcaption footer h1 h2 h3 h4 h5 h6 header hr kbd label legend li main nav option p pre section summary td textarea th".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = ("script", "style")
#: An element that opens closes these, if they are open, as browsers do.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
    **{t: {"p"} for t in "p div h1 h2 h3 h4 h5 h6 ul ol dl table section article aside header footer main nav pre blockquote form hr".split()},
}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"td", "th", "li", "div", "button", "body"}}


@dataclass(frozen=True)
class Rule:
    """selector: a CSS selector (see `matches`); field_name: what its text belongs to, if any."""

    selector: str
    field_name: str | None = None
    attributes: tuple[tuple[str, str], ...] = ()
    priority: int = 0


DEFAULT_RULES = (
    Rule("span[data-link]", None, (("data-link", "link"),)),
    Rule("title", "title"),
    Rule("h1", "h1"),
    Rule("body", "body"),
    Rule('meta[name="description"],meta[name="keywords"]', None, (("content", "body"),)),
    Rule("h2,h3,h4,h5,h6", "heading", (("id", "headingLink"),)),
)
DEFAULT_EXCLUDED = "script,style,form,nav,[data-search-ignore]"
_SIMPLE = re.compile(
    r"""(?P<tag>[\w-]+|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]*))\s*)?\]|:not\((?P<no>[^)]*)\)|:(?P<pseudo>first-child|first-of-type|root)"""
)
_JOIN = re.compile(r"\s*([>+~,])\s*|\s+")
#: (kind, name, value) that an element must meet.
_Test = tuple[str, str, str | None]


@lru_cache
def _parsed(selector: str) -> list[list[tuple[str, list[_Test]]]]:
    """The alternatives of a selector, each its compounds from left to right with what joins each to the one before: "", " ", ">", "+" or "~"."""
    out: list[list[tuple[str, list[_Test]]]] = []
    chain: list[tuple[str, list[_Test]]] = []
    tests: list[_Test] = []
    join, at, text = "", 0, selector.strip()
    while at < len(text):
        if m := _SIMPLE.match(text, at):
            value = next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), None)
            if m["tag"]:
                tests.append(("any" if m["tag"] == "*" else "tag", m["tag"].lower(), None))
            elif m["id"]:
                tests.append(("=", "id", m["id"]))
            elif m["cls"]:
                tests.append(("~=", "class", m["cls"]))
            elif m["attr"]:
                tests.append((m["op"] or "has", m["attr"].lower(), value))
            elif m["no"] is not None:
                tests.append(("not", m["no"], None))
            else:
                tests.append(("pseudo", m["pseudo"], None))
        elif (m := _JOIN.match(text, at)) and tests:
            chain.append((join, tests))
            join, tests = m[1] or " ", []
            if join == ",":
                out.append(chain)
                join, chain = "", []
        else:
            raise ValueError(f"{selector!r} is no selector that this reads")
        at = m.end()
    if not tests:
        raise ValueError(f"{selector!r} is no selector that this reads")
    return [*out, [*chain, (join, tests)]]


@dataclass
class Node:
    """An element as selectors see it: its attributes, the elements around it (outermost first) and those before it in its parent."""

    tag: str
    attrs: dict[str, str]
    around: list[Node] = field(default_factory=list)
    siblings: list[Node] = field(default_factory=list)
    place: int = 0

    @property
    def before(self) -> list[Node]:
        return self.siblings[: self.place]

    def meets(self, tests: list[_Test]) -> bool:
        return all(self._meets(*t) for t in tests)

    def _meets(self, kind: str, name: str, value: str | None) -> bool:
        if kind in ("any", "tag"):
            return kind == "any" or self.tag == name
        if kind == "not":
            return not selects(name, self)
        if kind == "pseudo":
            return not self.around if name == "root" else not self.before if name == "first-child" else all(x.tag != self.tag for x in self.before)
        own = self.attrs.get(name)
        if own is None or kind == "has":
            return own is not None
        if kind == "=":
            return own == value
        if kind == "~=":
            return value in own.split()
        if kind == "|=":
            return own == value or own.startswith(f"{value}-")
        return bool(value) and (own.startswith(value) if kind == "^=" else own.endswith(value) if kind == "$=" else value in own)


def _chain(node: Node, chain: list[tuple[str, list[_Test]]]) -> bool:
    join, tests = chain[-1]
    if not node.meets(tests):
        return False
    if len(chain) == 1:
        return True
    rest = chain[:-1]
    near = {" ": node.around, ">": node.around[-1:], "+": node.before[-1:], "~": node.before}[join]
    return any(_chain(x, rest) for x in near)


def selects(selector: str, node: Node) -> bool:
    return any(_chain(node, chain) for chain in _parsed(selector))


def matches(selector: str, tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element by itself is selected.

    Selectors: tag, *, #id, .class, [attr], [attr="value"] and its kinds ~= |= ^= $= *=, :not(), :first-child, :first-of-type, :root, joined by
    blanks (within), ">" (directly within), "+" (directly after), "~" (after), and lists by commas.
    """
    return selects(selector, Node(tag, attrs))


@dataclass
class _Element:
    tag: str
    field_name: str | None
    excluded: bool
    node: Node
    children: list[Node] = field(default_factory=list)


class _Zones(HTMLParser):
    def __init__(self, rules: tuple[Rule, ...], excluded: str):
        super().__init__(convert_charrefs=True)
        self.rules, self.excluded = sorted(rules, key=lambda r: -r.priority), excluded
        self.open: list[_Element] = []
        self.zones: list[list] = []
        self.apart = False
        self.top = _Element("", None, False, Node("", {}))

    @property
    def now(self) -> _Element:
        return self.open[-1] if self.open else self.top

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.close_implied(tag)
        named = {k: v or "" for k, v in attrs}
        if tag == "body" and any(e.tag == "body" for e in self.open):  # a second body only adds attributes
            return
        parent = self.now
        node = Node(tag, named, [e.node for e in self.open], parent.children, len(parent.children))
        parent.children.append(node)
        excluded = parent.excluded or bool(self.excluded and selects(self.excluded, node))
        name = parent.field_name
        if not excluded:
            for rule in self.rules:
                if selects(rule.selector, node):
                    self.zones += [[f, named[a], ATTRIBUTE] for a, f in rule.attributes if a in named]
                    if rule.field_name:
                        name = rule.field_name
                        break
            self.apart |= name is not None and tag in _SEPARATING
        if tag not in _VOID:
            self.open.append(_Element(tag, name, excluded, node))

    def close_implied(self, tag: str) -> None:
        closes = _CLOSES.get(tag)
        while closes and self.open:
            stop = _SCOPE.get(tag, set())
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag in closes:
                    self.leave(k)
                    break
                if self.open[k].tag in stop:
                    return
            else:
                return

    def leave(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        for e in self.open[k:]:
            self.apart |= not e.excluded and e.field_name is not None and e.tag in _SEPARATING
        del self.open[k:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("body", "html"):  # text after them still belongs to the body
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                self.leave(k)
                return
            if tag not in ("table", "div", "article", "section") and self.open[k].tag in ("td", "th", "table"):
                # cells may be closed by the other's tag; other ends don't reach out of a table
                if tag in ("td", "th") and self.open[k].tag in ("td", "th"):
                    self.leave(k)
                return

    def handle_data(self, text: str) -> None:
        if not self.open and text.strip():  # text before any element belongs to an implied body
            self.handle_starttag("body", [])
        e = self.now
        if e.excluded or e.field_name is None or e.tag in _RAW:
            return
        last = self.zones[-1] if self.zones else None
        if last and last[0] == e.field_name and not self.apart:
            last[1] += text
        else:
            self.zones.append([e.field_name, text, NEXT if last and last[0] == e.field_name else APART])
        self.apart = False


def page_zones(html: str | None, rules: tuple[Rule, ...] = DEFAULT_RULES, excluded: str = DEFAULT_EXCLUDED) -> list[tuple[str, str, int]]:
    """(field, text, separation) of a page's zones, in reading order; a null page has none."""
    if not html:
        return []
    reader = _Zones(rules, excluded)
    reader.feed(html)
    reader.close()
    return [(f, t, s) for f, t, s in reader.zones]


def html_zones(pages: DataFrame, html: str = "html", path: str | None = None, rules: tuple[Rule, ...] = DEFAULT_RULES, excluded: str = DEFAULT_EXCLUDED) -> DataFrame:
    """pages with `zones` for their html; a column of paths becomes each page's first zone."""
    rest = [c for c in pages.columns if c != html]
    kinds = dict(pages.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"zones array<{ZONE}>"])
    kind = pa.list_(pa.struct([("field", pa.string()), ("text", pa.string()), ("separation", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zones = pa.array([[{"field": f, "text": t, "separation": s} for f, t, s in page_zones(x, rules, excluded)] for x in batch.column(len(rest)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], zones], [*rest, "zones"])

    out = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html}`")).mapInArrow(run, schema)
    return out.withColumn("zones", F.concat(F.array(path_zone(F.col(path))), "zones")) if path else out


def path_zone(path: Column) -> Column:
    return F.struct(F.lit(PATH_FIELD).alias("field"), path.cast("string").alias("text"), F.lit(SEPARATION).alias("separation"))
