"""Building an inverted index: zones to tokens to postings, dictionary, lengths and facets.

A collection is a DataFrame of one row a document: doc_id, `zones` (an array of (field, text, separation) in reading
order), and any facet columns.  Positions run over all searched zones of a document; a sentence's end takes one place
and a zone's end its separation.  One narrow pass makes a document's postings; they are shuffled only to be laid out by term.
A posting holds its document's field lengths, so scoring a term reads nothing else.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FieldConfig, IndexConfig
from ..functions.analysis import GAP, Analyzer, analyzer_of
from ..storage import exists, spread

ZONE = "struct<field:string,text:string,separation:int>"
SEPARATION = 10


def one_zone(field_name: str, text: Column, separation: int = SEPARATION) -> Column:
    """The zones of a document that is one text."""
    return F.array(F.struct(F.lit(field_name).alias("field"), text.cast("string").alias("text"), F.lit(separation).alias("separation")))


def zones_of(columns: dict[str, Column], separation: int = SEPARATION) -> Column:
    """The zones of a document whose columns are fields; null texts are left out."""
    parts = [F.struct(F.lit(name).alias("field"), c.cast("string").alias("text"), F.lit(separation).alias("separation")) for name, c in columns.items()]
    return F.filter(F.array(*parts), lambda z: z["text"].isNotNull())


def _with_words(collection: DataFrame, config: IndexConfig) -> DataFrame:
    """collection with __words, __fields and __gaps of its searched zones, one entry a zone."""
    analyzer, scored = analyzer_of(config), config.scored
    field_id = F.create_map(*[x for i, f in enumerate(scored) for x in (F.lit(f.name), F.lit(i))]) if scored else None
    kept = F.filter("zones", lambda z: z["field"].isin(*[f.name for f in scored]) & z["text"].isNotNull())
    zones = collection.withColumn("__kept", F.coalesce(kept, F.array().cast(f"array<{ZONE}>")))
    return zones.withColumns(
        {
            "__words": F.transform("__kept", lambda z: analyzer.words(z["text"])),
            "__fields": F.transform("__kept", lambda z: F.element_at(field_id, z["field"])) if scored else F.array().cast("array<int>"),
            "__gaps": F.transform("__kept", lambda z: F.coalesce(z["separation"], F.lit(0))),
        }
    ).drop("__kept")


@dataclass
class _Tokens:
    """Tokens of some documents: each one's document (by number), position, field and term (by code)."""

    n: int
    doc: np.ndarray
    pos: np.ndarray
    field: np.ndarray
    code: np.ndarray
    terms: list[str]

    def lengths(self, fields: int) -> list[np.ndarray]:
        return [np.bincount(self.doc[self.field == i], minlength=self.n).astype(np.int32) for i in range(fields)]


#: Words that are looked at together, and words whose terms are remembered: a task's memory is bounded by both and by its batches.
_WORDS_AT_ONCE = 1 << 18
_KNOWN = 1 << 17


def _slices(words: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about _WORDS_AT_ONCE words; each has one document at least."""
    zones = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(words.flatten()), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(zones)])]
    i, n = 0, len(words)
    while i < n:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + _WORDS_AT_ONCE, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _read(words: pa.Array, fields: pa.Array, gaps: pa.Array, term: Callable[[str], str | None]) -> _Tokens:
    zones = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    per_zone = words.flatten()
    sizes = pc.list_value_length(per_zone).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = per_zone.flatten().dictionary_encode()
    numbers: dict[str, int] = {}
    become = np.empty(len(coded.dictionary), np.int64)  # -1: no term; -2: a gap
    for k, word in enumerate(coded.dictionary.to_pylist()):
        made = None if word == GAP else term(word)
        become[k] = -2 if word == GAP else -1 if made is None else numbers.setdefault(made, len(numbers))
    code = become[coded.indices.to_numpy(zero_copy_only=False)] if len(become) else np.zeros(0, np.int64)
    zone = np.repeat(np.arange(len(sizes)), sizes)
    kept = code != -1
    separation = gaps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.cumsum(kept) - kept + (np.cumsum(separation) - separation)[zone]
    of = np.repeat(np.arange(len(zones)), zones)  # each zone's document
    # what all documents before take, by zones: kept words and separations
    taken = np.bincount(zone[kept], minlength=len(sizes)) + separation
    before = np.concatenate([[0], np.cumsum(taken)])[np.cumsum(zones) - zones]
    doc = of[zone]
    pos = place - before[doc]
    own = code >= 0
    return _Tokens(len(zones), doc[own], pos[own], fields.flatten().to_numpy(zero_copy_only=False).astype(np.int64)[zone[own]], code[own], list(numbers))


def _batched(batches: Iterable[pa.RecordBatch], analyzer: Analyzer) -> Iterator[tuple[pa.RecordBatch, _Tokens]]:
    """Slices of batches whose last columns are __words, __fields and __gaps, with their tokens."""
    known: dict[str, str | None] = {}

    def term(word: str) -> str | None:
        if word not in known:
            if len(known) >= _KNOWN:  # only to bound memory: what is forgotten is worked out again
                known.clear()
            known[word] = analyzer.term(word)
        return known[word]

    for batch in batches:
        n = batch.num_columns
        for i, j in _slices(batch.column(n - 3)):
            part = batch.slice(i, j - i)
            yield part, _read(part.column(n - 3), part.column(n - 2), part.column(n - 1), term)


_INPUT = ("__words", "__fields", "__gaps")


def tokens(collection: DataFrame, config: IndexConfig) -> DataFrame:
    """(doc_id, pos, field_id, term) of every token."""
    analyzer = analyzer_of(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _batched(batches, analyzer):
            terms = pa.array(t.terms, pa.string()).take(pa.array(t.code))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t.doc)), pa.array(t.pos, pa.int32()), pa.array(t.field, pa.int32()), terms], ["doc_id", "pos", "field_id", "term"])

    return _with_words(collection, config).select("doc_id", *_INPUT).mapInArrow(run, f"doc_id {dict(collection.dtypes)['doc_id']}, pos int, field_id int, term string")


def _counts(collection: DataFrame, config: IndexConfig, by: Column) -> DataFrame:
    """(by, term, cf, df) of parts of a collection: tokens, and rows that hold the term.  Parts are added up by `by` and term."""
    analyzer = analyzer_of(config)
    rows = _with_words(collection, config).select(by.alias("by"), *_INPUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _batched(batches, analyzer):
            width = max(1, len(t.terms))
            held, n = np.unique(t.doc * width + t.code, return_counts=True)  # by row and term
            of = part.column(0).dictionary_encode("encode")
            own, at = np.unique(of.indices.to_numpy(zero_copy_only=False)[held // width] * width + held % width, return_inverse=True)
            cf, df = np.bincount(at, n, minlength=len(own)).astype(np.int64), np.bincount(at, minlength=len(own))
            yield pa.RecordBatch.from_arrays([of.dictionary.take(pa.array(own // width)), pa.array(t.terms, pa.string()).take(pa.array(own % width)), pa.array(cf), pa.array(df)], ["by", "term", "cf", "df"])

    return rows.mapInArrow(run, f"by {dict(rows.dtypes)['by']}, term string, cf bigint, df bigint")


def term_counts(collection: DataFrame, config: IndexConfig, by: str | None = None) -> DataFrame:
    """(term, cf), or (<by>, term, cf): how many tokens of each term a collection has, by a column of it."""
    rows = _counts(collection, config, F.col(by) if by else F.lit(0))
    keys = [F.col("by").alias(by), "term"] if by else ["term"]
    return rows.groupBy(*keys).agg(F.sum("cf").alias("cf"))


def term_frequencies(collection: DataFrame, config: IndexConfig) -> DataFrame:
    """(term, cf, df): df counts distinct doc_ids, null not among them.

    Rows are counted where their terms are made, so tokens are neither hashed nor shuffled; a doc_id of several rows is found
    beforehand, and its terms alone are made distinct.
    """
    ids = collection.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if ids.isEmpty():
        return _counts(collection, config, F.lit(0)).groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
    again = ids.select(F.col("doc_id").alias("__again"))
    marked = collection.join(again, F.col("doc_id").eqNullSafe(F.col("__again")), "left")
    several = F.col("__again").isNotNull() | F.col("doc_id").isNull()
    parts = _counts(marked, config, several).select("term", "cf", F.when(F.col("by"), F.lit(0)).otherwise(F.col("df")).alias("df"))
    more = tokens(marked.where(F.col("__again").isNotNull()).drop("__again"), config).select("term", "doc_id").distinct()
    rows = parts.unionByName(more.select("term", F.lit(0).cast("bigint").alias("cf"), F.lit(1).cast("bigint").alias("df")))
    return rows.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _built(collection: DataFrame, config: IndexConfig) -> DataFrame:
    """(term, doc_id, tf_<i>, pos_<i>, len_<i> ...), i a field's id: a row for each term of each document, and one without a term
    for each document, so that one pass makes postings and lengths.

    A document's tokens are grouped where they are made, so nothing is shuffled before postings are laid out.
    """
    analyzer, n, positions = analyzer_of(config), len(config.scored), config.with_positions
    names = ["term", "doc_id", *(f"{k}_{i}" for i in range(n) for k in (("tf", "pos") if positions else ("tf",))), *(f"len_{i}" for i in range(n))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _batched(batches, analyzer):
            key = t.doc * max(1, len(t.terms)) + t.code
            order = np.argsort(key, kind="stable")  # positions stay in order
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
            doc, code = t.doc[order][first], t.code[order][first]
            every = np.concatenate([doc, np.arange(t.n)])
            cols = [pa.array(t.terms, pa.string()).take(pa.array(np.concatenate([code, np.full(t.n, -1)]), mask=np.arange(len(every)) >= len(code))), part.column(0).take(pa.array(every))]
            for i in range(n):
                mine = t.field[order] == i
                tf = np.concatenate([np.bincount(group[mine], minlength=len(first)), np.zeros(t.n, np.int64)])
                cols.append(pa.array(tf, pa.int32()))
                if positions:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tf)]), pa.int32()), pa.array(t.pos[order][mine], pa.int32())))
            cols += [pa.array(length[every]) for length in t.lengths(n)]
            yield pa.RecordBatch.from_arrays(cols, names)

    kinds = {"term": "string", "doc_id": dict(collection.dtypes)["doc_id"]}
    schema = ", ".join(f"{c} {kinds.get(c) or ('array<int>' if c.startswith('pos') else 'int')}" for c in names)
    return _with_words(spread(collection), config).select("doc_id", *_INPUT).mapInArrow(run, schema)


def _parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of the rows of `_built`."""
    return rows.where("term IS NOT NULL"), rows.where("term IS NULL").select("doc_id", *[c for c in rows.columns if c.startswith("len_")])


def build_postings(collection: DataFrame, config: IndexConfig) -> DataFrame:
    """(term, doc_id, tf_<i>, pos_<i>, len_<i> ...), one row for each term of each document."""
    return _parted(_built(collection, config))[0]


def facet(collection: DataFrame, f: FieldConfig) -> Column:
    """A document's value of a facet field: its column if there is one, or the first fitting zone of that name."""
    if f.name in collection.columns:
        found = F.col(f"`{f.name}`").cast("string")
    else:
        found = F.try_element_at(F.filter("zones", lambda z: (z["field"] == f.name) & (F.trim(z["text"]) != "")), F.lit(1))["text"]
    return F.nullif(found, F.lit("")) if "enum" in f.storage else F.coalesce(number(found, f), F.lit(f.default).cast("bigint"))


def number(text: Column, f: FieldConfig) -> Column:
    """A number field's value; null where it can't be read.  Halves round away from zero; dates become epoch seconds."""
    if f.parse == "round":
        return F.round(text.try_cast("double")).cast("bigint")
    if f.parse == "datetime":
        return F.unix_timestamp(F.try_to_timestamp(text, F.lit(f.fmt))).cast("bigint")
    return text.try_cast("bigint")


#: The layout of stored indexes; a reader takes no other.
VERSION = 2
#: Estimated bytes of a collection whose postings one task lays out for a bucket, and the most such parts a bucket gets.
PART_BYTES, MOST_PARTS = 8 << 20, 64
#: Postings lists, and corrections, that an index remembers if it is asked to.
REMEMBERED = 8


@dataclass
class Index:
    """postings, docs (doc_id, facets, stored zones), lengths (doc_id, len_<i>) and what queries need of them.

    built: postings and lengths in one, where they are still to be worked out.  remember: keep the postings of the last
    REMEMBERED terms in memory, for a searcher that stays.
    """

    config: IndexConfig
    postings: DataFrame
    docs: DataFrame
    dictionary: DataFrame
    lengths: DataFrame
    built: DataFrame | None = None
    remember: bool = False
    analyzer: Analyzer = field(init=False)
    known: dict[str, int | None] = field(default_factory=dict, repr=False)
    corrected: OrderedDict[str, str | None] = field(default_factory=OrderedDict, repr=False)
    held: OrderedDict[str, DataFrame] = field(default_factory=OrderedDict, repr=False)

    def __post_init__(self) -> None:
        self.analyzer = analyzer_of(self.config)

    @cached_property
    def stats(self) -> tuple[int, list[float]]:
        """(live documents, mean length of each field over all live documents)."""
        n = range(len(self.config.scored))
        row = self.lengths.agg(F.count("*").alias("n"), *[F.sum(f"len_{i}").alias(f"l{i}") for i in n]).first()
        return row["n"], [(row[f"l{i}"] or 0) / row["n"] if row["n"] else 0.0 for i in n]

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Document frequency of those of terms that the index has; asked once of each term."""
        new = [t for t in dict.fromkeys(terms) if t not in self.known]
        if new:
            found = {r["term"]: r["df"] for r in self.dictionary.where(F.col("term").isin(*new)).collect()}
            self.known |= {t: found.get(t) for t in new}
        return {t: n for t in terms if (n := self.known[t]) is not None}

    def correction(self, word: str, ask: Callable[[], str | None]) -> str | None:
        """The correction of a word, asked for unless it is among the last REMEMBERED."""
        if word not in self.corrected:
            self.corrected[word] = ask()
            if len(self.corrected) > REMEMBERED:
                self.corrected.popitem(last=False)
        self.corrected.move_to_end(word)
        return self.corrected[word]

    def write(self, path: str) -> Index:
        """Store the index; postings lie by hash of their term, sorted, so that a query reads few row groups."""
        self.write_postings(f"{path}/postings")
        self.docs.write.parquet(f"{path}/docs")
        postings, _ = _laid(self.docs.sparkSession.read.parquet(f"{path}/postings"))
        frequencies(postings).sortWithinPartitions("term").write.parquet(f"{path}/dictionary")
        # what makes it an index is written last
        self.docs.sparkSession.createDataFrame([(manifest(self.config),)], "value string").coalesce(1).write.text(f"{path}/manifest")
        return read_index(self.docs.sparkSession, path)

    def write_postings(self, path: str, mode: str = "errorifexists") -> None:
        """Postings and, as bucket -1, lengths."""
        rows = self.built if self.built is not None else self.postings.unionByName(self.lengths, allowMissingColumns=True)
        rows = rows.drop("bucket", "segment")
        own = F.col("term").isNull()
        by = F.when(own, F.lit(-1)).otherwise(F.pmod(F.xxhash64("term"), F.lit(self.config.buckets)).cast("int"))
        spread = self._spread(rows)
        salt = F.pmod(F.xxhash64("doc_id"), F.when(own, spread * self.config.buckets).otherwise(spread))
        # with more parts than configured, so many tasks that few parts meet in one; else Spark's own number, which it may lower
        tasks = [2 * spread * self.config.buckets] if spread > self.config.spread else []
        laid = rows.withColumn("bucket", by).repartition(*tasks, "bucket", salt).sortWithinPartitions("bucket", "term", "doc_id")
        laid.write.mode(mode).partitionBy("bucket").parquet(path)
        if not exists(rows.sparkSession, f"{path}/bucket=-1"):  # no documents; the table still has its columns
            laid.limit(0).drop("bucket").write.mode(mode).parquet(f"{path}/bucket=-1")

    def _spread(self, rows: DataFrame) -> int:
        """Parts of a bucket: as configured, or for a large collection so many, up to MOST_PARTS, that a part's sort doesn't grow with it."""
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return max(self.config.spread, min(MOST_PARTS, -(-size // (self.config.buckets * PART_BYTES))))

    def scan(self, terms: list[str]) -> DataFrame:
        """Postings of a few terms: only their buckets are read."""
        if self.remember and 0 < len(terms) <= REMEMBERED:
            return reduce(DataFrame.unionByName, [self._held(t) for t in dict.fromkeys(terms)])
        return self._scan(terms)

    def _scan(self, terms: list[str]) -> DataFrame:
        rows = self.postings
        if "bucket" in rows.columns and terms:
            # constants once the plan is optimised, so whole directories are left out
            own = [F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(self.config.buckets)).cast("int") for t in terms]
            rows = rows.where(reduce(Column.__or__, own))
        return rows.where(F.col("term").isin(*terms) if terms else F.lit(False))

    def _held(self, term: str) -> DataFrame:
        if term not in self.held:
            self.held[term] = self._scan([term]).persist()
            if len(self.held) > REMEMBERED:
                self.held.popitem(last=False)[1].unpersist()
        self.held.move_to_end(term)
        return self.held[term]


def frequencies(postings: DataFrame) -> DataFrame:
    """(term, df)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def _laid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of a stored table of both."""
    return rows.where("bucket >= 0"), rows.where("bucket = -1").select("doc_id", *[c for c in rows.columns if c.startswith("len_") or c == "segment"])


def build_index(collection: DataFrame, config: IndexConfig) -> Index:
    """A lazy index of a collection; `write` stores it."""
    facets = [f for f in config.fields if {"enum", "i64"} & set(f.storage)]
    kept = [f.name for f in config.fields if "text" in f.storage]
    texts = F.transform(F.filter("zones", lambda z: z["field"].isin(*kept)), lambda z: F.struct(z["field"].alias("field"), z["text"].alias("text"))).alias("texts")
    docs = collection.select("doc_id", *[facet(collection, f).alias(f.name) for f in facets], texts)
    built = _built(collection, config)
    postings, lengths = _parted(built)
    return Index(config, postings, docs, frequencies(postings), lengths, built)


def manifest(config: IndexConfig) -> str:
    """What an index is made with, as JSON: its version, an id of its own and its configuration."""
    return json.dumps({"version": VERSION, "id": uuid.uuid4().hex, "config": asdict(config)}, sort_keys=True)


def configuration(text: str) -> IndexConfig:
    """The configuration in a manifest."""
    found = json.loads(text)
    if found["version"] != VERSION:
        raise ValueError(f"an index of version {found['version']}; this reads {VERSION}")
    c = found["config"]
    fields = tuple(FieldConfig(**(f | {"storage": tuple(f["storage"])})) for f in c["fields"])
    return IndexConfig(**(c | {"fields": fields, "stop_words": None if c["stop_words"] is None else tuple(c["stop_words"])}))


def read_index(spark: SparkSession, path: str, remember: bool = False) -> Index:
    """A stored index, by its own manifest."""
    if not exists(spark, f"{path}/manifest"):
        raise FileNotFoundError(f"{path} holds no index, or one that is still being written")
    config = configuration(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    postings, lengths = _laid(spark.read.parquet(f"{path}/postings"))
    return Index(config, postings, spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/dictionary"), lengths, remember=remember)
