"""Files of a folder as collections: HTML, CSV, JSON, text and PDF, each to (path, doc_no, zones).

Paths are relative to the folder.  Documents of one file are numbered from 0; `number_documents` gives all of them
stable ids in the order of their paths.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LINK_FIELD
from ..operators.index import SEPARATION, ZONE
from ..storage import stored
from .html import DEFAULT_EXCLUDED, DEFAULT_RULES, Rule, html_zones, path_zone
from .pdf import pdf_text

_KIND = pa.list_(pa.struct([("field", pa.string()), ("text", pa.string()), ("separation", pa.int32())]))


@dataclass(frozen=True)
class Loaders:
    """What each kind of file becomes.  A kind whose loader is None is left out."""

    html: tuple[Rule, ...] | None = DEFAULT_RULES
    html_excluded: str = DEFAULT_EXCLUDED
    #: Header or, without headers, column number to field, in the order in which zones are read.
    csv: dict[str | int, str] | None = field(default_factory=lambda: {"title": "title", "link": "link", "body": "body", "heading": "heading", "headingLink": "headingLink"})
    csv_options: dict[str, str] = field(default_factory=lambda: {"header": "true"})
    json: dict[str, str] | None = field(default_factory=lambda: {"title": "title", "body": "body", "h1": "h1", "heading": "heading", "headingLink": "headingLink", "link": "link", LINK_FIELD: LINK_FIELD})
    txt: str | None = "body"
    pdf: str | None = "body"


def _like(path: Column, globs: list[str]) -> Column:
    return reduce(Column.__or__, [path.rlike(fnmatch.translate(g).replace(r"\z", r"\Z")) for g in globs], F.lit(False))


def walk(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(path, ext, content, modified) of all files below a folder; excluding wins, and no includes means all.

    With `kinds`, only files of these extensions, in any case, are listed and read.
    """
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if kinds:
        files = files.option("pathGlobFilter", "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in k) for k in kinds) + "}")
    files = files.load(root)
    path = F.regexp_replace(F.col("path"), r"^.*?" + _quoted(root) + "/", "")
    out = files.select(path.alias("path"), F.lower(F.regexp_extract(F.col("path"), r"\.([^./]+)$", 1)).alias("ext"), "content", F.col("modificationTime").alias("modified"))
    keep = ~_like(F.col("path"), exclude or [])
    return out.where(keep & _like(F.col("path"), include) if include else keep)


def _quoted(path: str) -> str:
    bare = path.split("://")[-1] if "://" in path else path.removeprefix("file:")
    return "".join(f"[{c}]" if c in ".+*?()|{}$" else c for c in bare)


def html_files(files: DataFrame, loaders: Loaders) -> DataFrame:
    pages = files.where(F.col("ext").isin("html", "htm")).select("path", F.lit(0).alias("doc_no"), F.decode("content", "UTF-8").alias("html"))
    return html_zones(pages, "html", "path", loaders.html, loaders.html_excluded)


def txt_files(files: DataFrame, name: str) -> DataFrame:
    text = F.struct(F.lit(name).alias("field"), F.decode("content", "UTF-8").alias("text"), F.lit(SEPARATION).alias("separation"))
    return files.where("ext = 'txt'").select("path", F.lit(0).alias("doc_no"), F.array(path_zone(F.col("path")), text).alias("zones"))


def csv_zones(rows: DataFrame, fields: dict[str | int, str]) -> DataFrame:
    """rows with `zones` of their columns by name or number, in the mapping's order; missing columns and nulls are left out."""
    named = {c: f for c, f in ((rows.columns[k] if isinstance(k, int) and k < len(rows.columns) else k, f) for k, f in fields.items()) if c in rows.columns}
    parts = [F.struct(F.lit(f).alias("field"), F.col(f"`{c}`").cast("string").alias("text"), F.lit(SEPARATION).alias("separation")) for c, f in named.items()]
    return rows.withColumn("zones", F.filter(F.array(*parts), lambda z: z["text"].isNotNull()) if parts else F.array().cast(f"array<{ZONE}>"))


class _Lines:
    """A text's lines, split at line ends alone, without those that begin with `comment` where a record would begin."""

    def __init__(self, text: str, comment: str | None):
        self.lines, self.comment, self.fresh = io.StringIO(text, newline=""), comment, True

    def __iter__(self) -> _Lines:
        return self

    def __next__(self) -> str:
        line = next(self.lines)
        while self.fresh and self.comment and line.startswith(self.comment):
            line = next(self.lines)
        self.fresh = False
        return line


def csv_rows(text: str, sep: str = ",", quote: str = '"', escape: str | None = None, comment: str | None = None, double_quote: bool = True) -> Iterator[list[str]]:
    """The records of a CSV text; quoted fields may hold any line ends and marks, and empty lines are none."""
    lines = _Lines(text, comment)
    for row in csv.reader(lines, delimiter=sep, quotechar=quote, doublequote=double_quote and escape is None, escapechar=escape):
        lines.fresh = True
        if row:
            yield row


#: Rows of a file that are handed on at a time.
_ROWS = 10_000


def csv_files(files: DataFrame, loaders: Loaders) -> DataFrame:
    """A document a row; numbers follow the rows of each file.  Each file is read by its own header."""
    o, fields = loaders.csv_options, loaders.csv
    options = {"sep": o.get("sep", ","), "quote": o.get("quote", '"'), "escape": o.get("escape"), "comment": o.get("comment"), "double_quote": o.get("double_quote", "true") == "true"}
    with_header = o.get("header", "true") == "true"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = csv_rows(content.decode("utf-8-sig", "replace"), **options)
                header = next(rows, []) if with_header else []
                at = {k: (k if isinstance(k, int) else header.index(k) if k in header else None) for k in fields}
                for first in itertools.count(0, _ROWS):
                    zones = [[{"field": f, "text": row[at[k]], "separation": SEPARATION} for k, f in fields.items() if at[k] is not None and at[k] < len(row)] for row in itertools.islice(rows, _ROWS)]
                    if not zones:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(zones), pa.string()), pa.array(range(first, first + len(zones)), pa.int32()), pa.array(zones, _KIND)], ["path", "doc_no", "zones"])

    return files.select("path", "content").mapInArrow(run, f"path string, doc_no int, zones array<{ZONE}>")


def json_records(text: str, fields: dict[str, str]) -> list[list[tuple[str, str]]]:
    """The documents of a JSON text, each as (field, text) pairs in the mapping's order.

    An object is one document, an array one for each object in it.  Null values are left out; numbers stand as written;
    other values raise.
    """
    value = json.loads(text, parse_float=str, parse_int=str)
    out = []
    for one in value if isinstance(value, list) else [value]:
        if not isinstance(one, dict):
            continue
        pairs = []
        for key, name in fields.items():
            found = one.get(key)
            if isinstance(found, bool | list | dict):
                raise ValueError(f"{key} is neither text nor a number")
            if found is not None:
                pairs.append((name, found))
        out.append(pairs)
    return out


def json_files(files: DataFrame, fields: dict[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = content.decode("utf-8-sig", "replace")
                docs = json_records(text, fields)
                many = text.lstrip().startswith("[")
                zones = [[{"field": f, "text": t, "separation": SEPARATION} for f, t in [("_relative_fp", f"{path}#{i}" if many else path), *pairs]] for i, pairs in enumerate(docs)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(docs), pa.string()), pa.array(range(len(docs)), pa.int32()), pa.array(zones, _KIND)], ["path", "doc_no", "zones"])

    return files.where("ext = 'json'").select("path", "content").mapInArrow(run, f"path string, doc_no int, zones array<{ZONE}>")


def json_column(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """rows with `zones` of a column of JSON objects, without leaving the JVM; what a key lacks is left out."""
    parts = [F.struct(F.lit(f).alias("field"), F.get_json_object(F.col(column), f"$.{k}").alias("text"), F.lit(SEPARATION).alias("separation")) for k, f in fields.items()]
    return rows.withColumn("zones", F.filter(F.array(*parts), lambda z: z["text"].isNotNull()))


def pdf_files(files: DataFrame, name: str) -> DataFrame:
    """Text of PDFs; a broken file is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zones = [
                [{"field": "_relative_fp", "text": path, "separation": SEPARATION}, {"field": name, "text": pdf_text(content), "separation": SEPARATION}]
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * len(zones), pa.int32()), pa.array(zones, _KIND)], ["path", "doc_no", "zones"])

    return files.where("ext = 'pdf'").select("path", "content").mapInArrow(run, f"path string, doc_no int, zones array<{ZONE}>")


def with_linked(docs: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """docs with the zones of files that their _add_files zones name, relative to the naming file, and so on.

    Each round joins the links that are still open with all documents of their file among `every` (docs itself by
    default), until none is; each is written, so that no file is parsed again.  A link to a file that is missing adds nothing, and
    one that was followed before for the same document is passed over, so links may go in circles.  Zones keep their order: a document's own
    first.  A file that others link stays a document of its own, unless its path is excluded.  `linked` lists what was
    linked, missing files included.
    """
    links = F.transform(F.filter("zones", lambda z: z["field"] == LINK_FIELD), lambda z: _resolved(F.col("path"), z["text"]))
    plain = F.filter("zones", lambda z: z["field"] != LINK_FIELD)
    none, empty = F.array().cast(f"array<{ZONE}>"), F.array().cast("array<string>")
    own = stored(docs.select("path", "doc_no", plain.alias("zones"), links.alias("open")), "parsed")
    state, by_file = own.withColumn("seen", F.array("path")), None
    while not state.where(F.size("open") > 0).isEmpty():
        if by_file is None:
            linked = own if every is None else every.select("path", "doc_no", plain.alias("zones"), links.alias("open"))
            gathered = linked.groupBy(F.col("path").alias("to")).agg(F.sort_array(F.collect_list(F.struct("doc_no", "zones", "open"))).alias("all"))
            by_file = stored(gathered.select("to", F.flatten(F.transform("all", lambda x: x["zones"])).alias("more"), F.flatten(F.transform("all", lambda x: x["open"])).alias("then")), "files")
        opened = state.select("path", "doc_no", "seen", F.posexplode(F.array_distinct("open")).alias("k", "to")).where(~F.array_contains("seen", F.col("to")))
        found = opened.join(by_file, "to", "left").groupBy("path", "doc_no").agg(F.sort_array(F.collect_list(F.struct("k", "to", "more", "then"))).alias("found"))
        state = state.join(found, ["path", "doc_no"], "left").select(
            "path", "doc_no",
            F.concat("zones", F.coalesce(F.flatten(F.transform("found", lambda x: F.coalesce(x["more"], none))), none)).alias("zones"),
            F.coalesce(F.flatten(F.transform("found", lambda x: F.coalesce(x["then"], empty))), empty).alias("open"),
            F.concat("seen", F.coalesce(F.transform("found", lambda x: x["to"]), empty)).alias("seen"),
        )
        state = stored(state, "linked")
    return state.select("path", "doc_no", "zones", F.slice("seen", 2, 1 << 20).alias("linked"))


def _resolved(base: Column, link: Column) -> Column:
    """A link's path from the folder: beside the file that names it, with . and .. taken out however deep they are."""
    steps = F.split(F.concat(F.regexp_replace(base, "[^/]*$", ""), link), "/")

    def go(done: Column, step: Column) -> Column:
        up = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        back = F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(F.lit(".."))))
        return F.when(step.isin("", "."), done).when(step == "..", back).otherwise(F.concat(done, F.array(step)))

    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), lambda done, step: F.when(F.size(done) == 0, F.when(step.isin("", "."), done).otherwise(F.array(step))).otherwise(go(done, step))), "/")


def load_folder(spark: SparkSession, folder: str, loaders: Loaders | None = None, include: list[str] | None = None, exclude: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """(path, doc_no, zones, linked) of all documents of a folder's files that some loader reads.

    Each kind of file is listed and read by itself.  only: the paths (path) whose documents are wanted; other files are parsed only
    if those link files at all, and linked files are found even where they are excluded.
    """
    loaders = loaders or Loaders()

    def parsed(include: list[str] | None, exclude: list[str] | None, only: DataFrame | None) -> DataFrame:
        def files(*kinds: str) -> DataFrame:
            found = walk(spark, folder, include, exclude, kinds)
            return found if only is None else found.join(only, "path", "left_semi")

        parts = []
        if loaders.html is not None:
            parts.append(html_files(files("html", "htm"), loaders))
        if loaders.csv is not None:
            parts.append(csv_files(files("csv"), loaders))
        if loaders.json is not None:
            parts.append(json_files(files("json"), loaders.json))
        if loaders.txt is not None:
            parts.append(txt_files(files("txt"), loaders.txt))
        if loaders.pdf is not None:
            parts.append(pdf_files(files("pdf"), loaders.pdf))
        return reduce(DataFrame.unionByName, parts)

    whole = only is None and not include and not exclude
    return with_linked(parsed(include, exclude, only), None if whole else parsed(None, None, None))


def number_documents(docs: DataFrame, after: int = -1) -> DataFrame:
    """docs with doc_id in the order of path and doc_no: exact ranks from counts of each file, so no task sorts all rows."""
    counts = docs.groupBy("path").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("path", "base")
    within = F.row_number().over(Window.partitionBy("path").orderBy("doc_no")) - 1
    return docs.withColumn("k", within).join(base, "path").withColumn("doc_id", F.col("base") + F.col("k") + F.lit(after + 1)).drop("base", "k")
