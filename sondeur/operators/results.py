"""What is shown of a document: stored fields, segments under headings, highlights, titles and links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import Index

#: Characters around a match, and of a preview without one.
AROUND, PREVIEW = 40, 80
HEADING, CONTENT, BOTH = "heading", "content", "heading-content"


def stored_fields(top: DataFrame, index: Index) -> DataFrame:
    """top with the stored zones of its documents; top is a page of results, so its side is the small one."""
    return top.join(index.docs.select("doc_id", "texts"), "doc_id", "left")


def first_values(rows: DataFrame, *names: str) -> DataFrame:
    """rows with the first text of each of the named fields, null if a document has none."""

    def first(name: str) -> Column:
        return F.try_element_at(F.filter("texts", lambda x: x["field"] == name), F.lit(1))["text"]

    return rows.withColumns({name: first(name) for name in names})


def patterns(forms: list[list[str]], stemmed: bool = False) -> list[re.Pattern[str]]:
    """One pattern for each searched term: any of its forms between word bounds, longest first; stems may go on as a word."""
    tail = r"(\w*?)" if stemmed else "()"
    return [re.compile(rf"(^|\W|_)({'|'.join(re.escape(f) for f in sorted(some, key=len, reverse=True))}){tail}(?=\W|$)", re.IGNORECASE) for some in forms if some]


@cache
def _word(pattern: str) -> str | None:
    """The form, in lower case, of a pattern of `patterns` for one form of ASCII letters and digits; None for any other pattern."""
    one = re.fullmatch(r"\(\^\|\\W\|_\)\(([A-Za-z0-9]+)\)\(\)\(\?=\\W\|\$\)", pattern)
    return one[1].lower() if one else None


def _matches(text: str, low: str | None, p: re.Pattern[str]) -> list[tuple[int, int]]:
    """(position, length) of a pattern's matches; low: an ASCII text in lower case, in which a plain word is looked for without the pattern."""
    word = _word(p.pattern) if low is not None else None
    if word is None:
        return [(m.start(2), len(m[2]) + len(m[3])) for m in p.finditer(text)]
    out, at, n = [], low.find(word), len(word)
    while at >= 0:
        end = at + n
        if (at == 0 or not low[at - 1].isalnum()) and (end == len(low) or not (low[end].isalnum() or low[end] == "_")):
            out.append((at, n))
        at = low.find(word, end if out and out[-1][0] == at else at + 1)
    return out


def closest(text: str, terms: list[re.Pattern[str]]) -> list[tuple[int, int]]:
    """(position, length) of one match of each term that occurs, as near to each other as they come, by position."""
    low = text.lower() if text.isascii() else None
    found = []
    for k, p in enumerate(terms):
        found += [(at, n, k) for at, n in _matches(text, low, p)]
    found.sort()
    present = {k for _, _, k in found}
    last: dict[int, tuple[int, int]] = {}
    best, window = None, []
    for pos, length, k in found:
        last[k] = (pos, length)
        if len(last) == len(present):
            wide = pos - min(p for p, _ in last.values())
            if best is None or wide < best:
                best, window = wide, sorted(last.values())
    return window


def highlight(text: str, window: list[tuple[int, int]], dots: str = " ... ", ends: bool = True) -> str:
    """The text around a window's matches, which stand in <mark>; without matches, its beginning."""

    def safe(s: str) -> str:
        return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    if not window:
        if not ends:
            return safe(text)
        start = text.lstrip()[:PREVIEW]
        return safe(re.sub(r"\w+$", "", start) if len(start) == PREVIEW else start) + dots
    spans: list[list[int]] = []  # matches, merged where they overlap
    for pos, length in window:
        if spans and pos < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], pos + length)
        else:
            spans.append([pos, pos + length])
    out, upto = [], 0
    for i, (a, b) in enumerate(spans):
        if a > upto + 2 * AROUND:
            left = text[a - AROUND : a]
            if i:
                right = text[upto : upto + AROUND]
                out.append(safe(re.sub(r"\w+$", "", right)))
            out += [dots if ends else "", safe(re.sub(r"^\w+", "", left))]
        else:
            out.append(safe(text[upto:a]))
        out.append(f"<mark>{safe(text[a:b])}</mark>")
        upto = b
    right = text[upto : upto + AROUND]
    out.append(safe(re.sub(r"\w+$", "", right) if len(right) == AROUND else right))
    return "".join(out) + (dots if ends else "")


def linked(texts: list[tuple[str, str]], content: tuple[str, ...]) -> list[dict]:
    """Segments of a document: each heading, and each run of content under its heading."""
    out: list[dict] = []
    heading = None
    link, link_at = "", -2
    k = 0
    while k < len(texts):
        name, text = texts[k]
        if name == "headingLink":
            link, link_at = text, k
        elif name == "heading":
            heading = {"type": HEADING, "text": text, "heading": None, "heading_link": link if link_at == k - 1 else None}
            out.append(heading)
        elif name in content:
            run = [text]
            while k + 1 < len(texts) and texts[k + 1][0] in content:
                k += 1
                if texts[k][1].strip():
                    run.append(texts[k][1])
            out.append({"type": BOTH if heading else CONTENT, "text": " ... ".join(run), "heading": heading["text"] if heading else None, "heading_link": heading["heading_link"] if heading else None})
        k += 1
    return out


def document_segments(texts: list[tuple[str, str]], terms: list[re.Pattern[str]], content: tuple[str, ...]) -> list[dict]:
    out = linked(texts, content)
    for i, s in enumerate(out):
        window = closest(s["text"], terms)
        count = len(window) + (len(closest(s["heading"], terms)) if s["type"] == BOTH else 0)
        s |= {"seg_no": i, "num_terms": count, "chars": len(s["text"]), "window": [{"pos": p, "len": n} for p, n in window], "highlight": highlight(s["text"], window)}
    return out


#: Characters of text whose segments are held at a time (a single longer document is taken whole).
_CHARS_AT_ONCE = 1 << 20
#: The columns of segments; chars, the length of their text, only where it is asked for.
_COLUMNS = {"chars": "int", "seg_no": "int", "type": "string", "text": "string", "heading": "string", "heading_link": "string", "num_terms": "int", "window": "array<struct<pos:int,len:int>>", "highlight": "string"}
_ARROW = {"int": pa.int32(), "string": pa.string(), "array<struct<pos:int,len:int>>": pa.list_(pa.struct([("pos", pa.int32()), ("len", pa.int32())]))}


def segments(rows: DataFrame, forms: list[list[str]], content: tuple[str, ...] = ("body",), stemmed: bool = False, columns: tuple[str, ...] = tuple(_COLUMNS)[1:], most: int | None = None) -> DataFrame:
    """(doc_id, seg_no, type, text, heading, heading_link, num_terms, window, highlight) of rows (doc_id, texts), or those of `columns` alone.

    most: only so many of each row's segments, those that `best_segments` puts first; whichever it takes are among them.
    """
    terms = patterns(forms, stemmed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found, held = [], [], 0

            def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *(pa.array([s[n] for s in found], _ARROW[_COLUMNS[n]]) for n in columns)], ["doc_id", *columns])

            for i, texts in enumerate(batch.column(1)):  # one document's objects at a time
                texts = [(x["field"], x["text"]) for x in texts.as_py() or ()]
                some = document_segments(texts, terms, content)
                if most is not None and len(some) > most:
                    some = sorted(some, key=lambda s: (s["num_terms"], s["type"], s["chars"], -s["seg_no"]), reverse=True)[:most]
                own += [i] * len(some)
                found += some
                held += sum(len(t or "") for _, t in texts)
                if held >= _CHARS_AT_ONCE:
                    yield made()
                    own, found, held = [], [], 0
            if found:
                yield made()

    schema = ", ".join([f"doc_id {dict(rows.dtypes)['doc_id']}", *(f"{n} {_COLUMNS[n]}" for n in columns)])
    return rows.select("doc_id", "texts").mapInArrow(run, schema)


def best_segments(found: DataFrame, most: int = 2) -> DataFrame:
    """The best segments of each document: most terms, then the fuller type, then the longer text; only those as good as the first.  found has their text, or chars."""
    chars = F.col("chars") if "chars" in found.columns else F.char_length("text")
    per = Window.partitionBy("doc_id").orderBy(F.desc("num_terms"), F.desc("type"), F.desc(chars), "seg_no")
    first = F.first(F.struct("num_terms", "type")).over(per.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = found.withColumn("place", F.row_number().over(per)).withColumn("first", first)
    return ranked.where((F.col("place") <= most) & (F.col("num_terms") == F.col("first.num_terms")) & (F.col("type") == F.col("first.type"))).drop("first")


def breadcrumb(path: Column) -> Column:
    """A title from a path: its parts in words with capitals, without .html and with (PDF) for PDFs."""
    words = F.regexp_replace(F.regexp_replace(path, r"[\s_-]+", " "), "([a-z])([A-Z])", "$1 $2")
    parts = F.transform(F.split(words, "/"), lambda p: F.array_join(F.transform(F.split(p, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " "))
    whole = F.array_join(parts, " » ")
    stem, ext = F.regexp_replace(whole, r"\.[^.]*$", ""), F.upper(F.regexp_extract(whole, r"([^.]*)$", 1))
    return F.when(~whole.contains("."), F.concat(F.lit("."), F.upper(whole))).otherwise(F.concat(stem, F.when(ext == "HTML", "").when(ext == "PDF", " (PDF)").otherwise(F.concat(F.lit("."), ext))))


def title(own: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(own, F.lit("")), breadcrumb(path))


def result_link(link: Column, path: Column, base: str, heading_link: Column | None = None) -> Column:
    """A document's own link or its path below a base, with the heading's anchor."""
    out = F.coalesce(link, F.concat(F.lit(base), path))
    return out if heading_link is None else F.concat(out, F.coalesce(F.concat(F.lit("#"), heading_link), F.lit("")))
