"""The query language: text to a tree of parts, before any data is touched.

Terms are optional; +term must match, -term must not, ~term stands for all documents without it; "a b" is a phrase,
( ) a group, field: restricts the next part, term* takes longer terms too, and a backslash makes the next character
ordinary.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from ..functions.analysis import Analyzer

QUOTES = '"″‶“”❝❞＂'
TERM, PHRASE, GROUP = "TERM", "PHRASE", "BRACKET"


@dataclass
class Part:
    kind: str
    original: str | None = None
    term: str | None = None
    forms: list[str] = field(default_factory=list)
    children: list[Part] | None = None
    field_name: str | None = None
    mandatory: bool = False
    subtracted: bool = False
    inverted: bool = False
    wildcard: bool = False
    auto_suffix: bool = False
    suffixed: bool = False
    corrected: bool = False
    weight: float = 1.0

    def mark(self, ops: Marks) -> None:
        if not (self.mandatory or self.subtracted):
            self.mandatory, self.subtracted = ops.mandatory, ops.subtracted
        self.inverted |= ops.inverted

    def walk(self) -> Iterable[Part]:
        yield self
        for c in self.children or ():
            yield from c.walk()


@dataclass(frozen=True)
class Marks:
    mandatory: bool = False
    subtracted: bool = False
    inverted: bool = False


@dataclass
class _Field:
    """A field operator that waits for the part it applies to."""

    name: str
    ops: Marks


class _Reader:
    """One pass over a query.  `start` begins the text not yet read as terms; operators reach back to `floor` at most."""

    def __init__(self, text: str, analyzer: Analyzer, fields: list[str], phrases: bool):
        self.text, self.analyzer, self.phrases = text, analyzer, phrases
        self.fields = sorted(fields, key=lambda f: -len(f))
        self.parts: list[Part] = []
        self.waiting: list[_Field | None] = []  # None is an open group
        self.escapes: list[int] = []
        self.start = self.floor = 0

    def marks_before(self, at: int, floor: int) -> Marks:
        """The operators that end right before `at`, if blank or nothing stands before them."""
        at -= 1
        if at < floor:
            return Marks()
        behind = max((e + 2 for e in self.escapes if e < at), default=0)
        need = avoid = without = False
        for c in reversed(self.text[max(floor, behind) : at + 1]):
            if c == "+":
                need |= not avoid
            elif c == "-":
                avoid |= not need
            elif c == "~":
                without = True
            elif self.analyzer.ends_operator(c):
                break
            else:
                return Marks()
        return Marks(need, avoid, without)

    def add(self, part: Part) -> None:
        """A finished part, which the fields that wait since the last open group apply to."""
        self.parts.append(part)
        self.settle()

    def settle(self) -> None:
        while self.waiting and self.waiting[-1] is not None:
            op = self.waiting.pop()
            if self.parts and self.parts[-1].field_name is None:
                self.parts[-1].field_name = op.name
                self.parts[-1].mark(op.ops)

    def terms(self, end: int) -> list[Part]:
        """The terms of the text from `start` to `end`."""
        text = self.text[self.start : end]
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        pieces, out = self.analyzer.split(text), []
        for k, (offset, piece) in enumerate(pieces):
            if not self.analyzer.is_term(piece):
                continue
            term, forms = self.analyzer.inflections(piece)
            if not term:
                continue
            star = k + 1 < len(pieces) and pieces[k + 1][1] == "*"
            part = Part(TERM, original=term, term=term, forms=forms, wildcard=star, auto_suffix=not text.endswith(" "))
            part.mark(self.marks_before(self.start + offset, self.start))
            out.append(part)
        return out

    def free_text(self, end: int) -> None:
        found = self.terms(end) if end > self.start else []
        self.parts += found[:1]
        if found:
            self.settle()
        self.parts += found[1:]

    def quoted(self, end: int) -> None:
        inner = [replace(p, mandatory=True, subtracted=False, inverted=False, wildcard=False, auto_suffix=False) for p in self.terms(end)]
        part = Part(PHRASE, children=inner)
        part.mark(self.marks_before(self.start - 1, self.floor))
        self.add(part)
        self.start = self.floor = end + 1

    def close_group(self, at: int) -> None:
        if not self.waiting or self.waiting[-1] is not None:
            return
        opened = max((i for i, p in enumerate(self.parts) if p.kind == GROUP and p.children is None), default=None)
        if opened is None:
            return
        self.parts[opened].children = self.parts[opened + 1 :]
        del self.parts[opened + 1 :]
        self.waiting.pop()
        self.settle()
        self.floor = at + 1

    def field_name(self, at: int) -> None:
        for name in self.fields:
            begin = at - len(name)
            if begin >= 0 and self.text[begin:at] == name:
                self.free_text(begin)
                self.waiting.append(_Field(name, self.marks_before(begin, self.floor)))
                self.start = self.floor = at + 1
                return

    def read(self) -> list[Part]:
        quote = escaped = False
        for at, c in enumerate(self.text):
            if escaped:
                escaped = False
                continue
            if c == "\\":
                self.escapes.append(at)
                escaped = True
            elif quote:
                if c in QUOTES:
                    quote = False
                    self.quoted(at)
            elif c in QUOTES and self.phrases:
                self.free_text(at)
                self.start, quote = at + 1, True
            elif c == "(":
                self.free_text(at)
                part = Part(GROUP)
                part.mark(self.marks_before(at, self.floor))
                self.parts.append(part)
                self.waiting.append(None)
                self.start = at + 1
            elif c == ")":
                self.free_text(at)
                self.start = at + 1
                self.close_group(at)
            elif c == ":":
                self.field_name(at)
        self.free_text(len(self.text))
        return self.parts


def parse(text: str, analyzer: Analyzer, fields: list[str], phrases: bool = True) -> list[Part]:
    """The parts of a query.  Their terms aren't looked up yet; see `resolve`."""
    return _Reader(text, analyzer, fields, phrases).read()


def to_json(parts: list[Part]) -> str:
    """A query's tree as JSON, for clients that highlight or explain it."""

    def one(p: Part) -> dict:
        return {
            "isMandatory": p.mandatory, "isSubtracted": p.subtracted, "isInverted": p.inverted, "isCorrected": p.corrected,
            "autoSuffixWildcard": p.auto_suffix, "suffixWildcard": p.wildcard, "isSuffixed": p.suffixed, "originalTerm": p.original, "term": p.term,
            "termsSearched": p.forms if p.kind == TERM else None, "partType": p.kind, "fieldName": p.field_name, "children": None if p.children is None else [one(c) for c in p.children],
        }

    return json.dumps([one(p) for p in parts], ensure_ascii=False)
