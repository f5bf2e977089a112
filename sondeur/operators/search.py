"""Queries over an index: ranked documents, facets, sorting, paging."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchOptions
from ..plans.compile import compile_query
from ..plans.query import Part, parse, to_json
from ..plans.resolve import expand, resolve
from .index import Index


def facet_filters(docs: DataFrame, options: SearchOptions) -> Column:
    """Whether a document passes all facets.  Unknown fields are ignored; so is a facet that allows nothing known."""
    out = F.lit(True)
    for name, allowed in options.enums.items():
        if name in docs.columns:
            some = [v for v in allowed if v is not None]
            ok = F.col(name).isin(*some) if some else F.lit(False)
            out = out & F.coalesce(ok | F.col(name).isNull() if None in allowed else ok, F.lit(False))
    for name, (low, high) in options.ranges.items():
        if name in docs.columns:
            out = out & (F.col(name) >= low if low is not None else F.lit(True)) & (F.col(name) <= high if high is not None else F.lit(True))
    return out


def ticked(values: list[str | None], chosen: list[str | None]) -> list[str | None] | None:
    """The facet of a row of tick boxes: all or none ticked is no facet."""
    return None if not chosen or set(chosen) >= set(values) else chosen


def days(first: str | None, last: str | None) -> tuple[int | None, int | None]:
    """The range of epoch seconds from the start of one day to the end of another, both as yyyy-mm-dd and in UTC; either may be open."""
    start = lambda day: int(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp())
    return start(first) if first else None, start(last) + 86_399 if last else None


@dataclass
class Query:
    """A compiled query.  matches: (doc_id, score, facets) of all documents, before any limit."""

    index: Index
    parts: list[Part]
    options: SearchOptions
    matches: DataFrame

    @property
    def order(self) -> list[Column]:
        by = [F.asc("__sort") if self.options.ascending else F.desc("__sort")] if self.options.sort else []
        return [*by, F.desc(F.round("score", 9)), F.asc("doc_id")]

    def ranked(self) -> DataFrame:
        rows = self.matches.withColumn("__sort", F.col(self.options.sort)) if self.options.sort else self.matches
        return rows

    def top(self, k: int) -> DataFrame:
        """The first k documents, at most the limit of results: one TakeOrdered, no full sort."""
        limit = k if self.options.result_limit is None else min(k, self.options.result_limit)
        return self.ranked().orderBy(*self.order).limit(limit).drop("__sort")

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number`, from 0, with each document's rank from 1: ranks are given to the pages so far, not to all matches."""
        return self.top((number + 1) * size).withColumn("rank", F.row_number().over(Window.orderBy(*([F.asc(self.options.sort) if self.options.ascending else F.desc(self.options.sort)] if self.options.sort else []), F.desc(F.round("score", 9)), F.asc("doc_id")))).where(F.col("rank") > number * size)

    def total(self) -> DataFrame:
        return self.matches.agg(F.count("*").alias("results_total"))

    def forms(self) -> list[str]:
        """The spellings to highlight: all forms of terms that aren't excluded."""
        out: list[str] = []

        def go(p: Part, excluded: bool) -> None:
            excluded |= p.subtracted or p.inverted
            if not excluded:
                out.extend(p.forms)
            for c in p.children or ():
                go(c, excluded)

        for p in self.parts:
            go(p, False)
        return list(dict.fromkeys(x for x in out if x))

    def json(self) -> str:
        return to_json(self.parts)


def search(index: Index, text: str, options: SearchOptions | None = None) -> Query:
    """Parse, look up, expand and compile a query."""
    options = options or SearchOptions()
    parts = parse(text, index.analyzer, [f.name for f in index.config.scored], index.config.with_positions)
    parts = expand(resolve(parts, index), index, options)
    found = compile_query(parts, index, options)
    needed = [c for c in {*options.enums, *options.ranges, *([options.sort] if options.sort else [])} if c in index.docs.columns]
    if needed:
        facets = index.docs.select("doc_id", *needed).where(facet_filters(index.docs, options))
        found = found.join(facets, "doc_id")
    return Query(index, parts, options, found)


def facet_values(index: Index, name: str) -> DataFrame:
    """The distinct values of an enum facet."""
    return index.docs.select(F.col(name).alias("value")).where("value IS NOT NULL").distinct()
