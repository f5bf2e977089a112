"""Token counts through a digest cache.

A text is normalised (NFC, line ends as line feeds) and digested (xxh3, 128 bits).  A cache, a Parquet folder that is
only ever appended to, holds the counts of known digests, apart for each tokenizer version, which is itself a digest
of the vocabulary file and its settings.  Of the rows that hold a digest the cache lacks one is chosen, and its text is
encoded where it is read: the first pass notes each row's place (its partition, and its number there), the places of
chosen rows are written one file a partition, and the second pass reads its own file.  So digests are shuffled and texts are not.
A place counts only if the text there has the digest; where a second reading yields its rows in other places, as after an
unordered shuffle, what is still missing is gathered by digest instead.  Then all documents are joined with the cache.  A
tokenizer whose file changes is another version and shares nothing with the old one.

Defined results: a null or empty text has 0 tokens, and is cached like any other.  Every row gives one row, a null
doc_id and repeated rows included.  A text that holds a special token's string is encoded as ordinary text.  Very long texts
are encoded whole.  If two runs append the same digest at once the cache holds it twice, alike, and one is read.  A lost
executor's tasks run again; the cache gains their rows once, when the append commits.  Columns beside doc_id and text don't
matter.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exists, qualified, shared_folder, small, stored

#: Where vocabularies are unless a Tokenizer names its file.
FOLDER = "/opt/tokenizers"
#: The split of byte-level vocabularies into pieces, as their makers publish it.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts encoded at a time.
_BATCH = 256


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary file, read on the driver and sent to the executors with the job; its ending names its library."""

    path: str = f"{FOLDER}/byte_bpe_50k.tiktoken"
    pieces: str = PIECES
    data: bytes = field(default=b"", repr=False)

    def loaded(self) -> Tokenizer:
        if self.data:
            return self
        with open(self.path, "rb") as f:
            return Tokenizer(self.path, self.pieces, f.read())

    @property
    def version(self) -> str:
        """The digest of the file, its kind and settings."""
        me, kind = self.loaded(), self.path.rpartition(".")[2]
        return hashlib.sha256(b"\0".join((kind.encode(), self.pieces.encode() if kind == "tiktoken" else b"", me.data))).hexdigest()[:32]

    def counter(self) -> Callable[[list[str]], list[int]]:
        """Texts to their numbers of tokens."""
        me, kind = self.loaded(), self.path.rpartition(".")[2]
        if kind == "tiktoken":
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, me.data.splitlines())}
            one = tiktoken.Encoding(me.version, pat_str=me.pieces, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: [len(one.encode_ordinary(t)) for t in texts]
        if kind == "json":
            import tokenizers

            many = tokenizers.Tokenizer.from_str(me.data.decode())
            many.encode_special_tokens = True
            return lambda texts: [len(e.ids) for e in many.encode_batch_fast(texts, add_special_tokens=False)]
        if kind == "model":
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_proto=me.data)
            return lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
        raise ValueError(f"no library reads {self.path}")


def normalised(text: str | None) -> str:
    text = text or ""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def digested(texts: list[str | None]) -> list[bytes]:
    return [xxhash.xxh3_128_digest(normalised(t).encode()) for t in texts]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, part, at) of every row: part and at are its place in this reading of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digested(batch.column(1).to_pylist()), pa.binary()), pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], ["doc_id", "digest", "part", "at"])
            at += n

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, digest binary, part int, at bigint")


def read_cache(docs: DataFrame, cache: str, version: str) -> DataFrame | None:
    """(digest, n_tokens) that the cache holds for a tokenizer version; None if it holds none."""
    if not exists(docs.sparkSession, f"{cache}/{version}"):
        return None
    found = docs.sparkSession.read.schema("digest binary, n_tokens bigint").parquet(f"{cache}/{version}")
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode(tokenizer: Tokenizer, texts: list[str], digest: list[bytes]) -> Iterator[pa.RecordBatch]:
    kept = sys.__dict__.setdefault("_sondeur_counters", {})  # a worker process that serves several tasks loads a vocabulary once
    if tokenizer.version not in kept:
        kept[tokenizer.version] = tokenizer.counter()
    for k in range(0, len(texts), _BATCH):
        sizes = kept[tokenizer.version](texts[k : k + _BATCH])
        yield pa.RecordBatch.from_arrays([pa.array(digest[k : k + _BATCH], pa.binary()), pa.array(sizes, pa.int64())], ["digest", "n_tokens"])


_COUNTS = "digest binary, n_tokens bigint"


def in_place(docs: DataFrame, chosen: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(digest, n_tokens) of the rows of docs that stand at the places `chosen` (part, at) with the digest they had there."""
    at = f"{shared_folder(docs.sparkSession)}/chosen-{uuid.uuid4().hex}"
    chosen.select("part", "at", "digest").repartition("part").sortWithinPartitions("part", "at").write.option("maxRecordsPerFile", 0).partitionBy("part").parquet(at)
    uri = qualified(docs, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(uri)
        folder = f"{root}/part={TaskContext.get().partitionId()}"
        if system.get_file_info(folder).type == pafs.FileType.NotFound:
            return
        files = sorted(f.path for f in system.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".parquet"))
        held = pa.concat_tables([pq.read_table(f, columns=["at", "digest"], filesystem=system, partitioning=None) for f in files]).sort_by("at")
        place, digest, first = held["at"].to_numpy(), held["digest"], 0
        for batch in batches:
            i, j = np.searchsorted(place, [first, first + batch.num_rows])
            if i < j:
                texts = [normalised(t) for t in batch.column(0).take(pa.array(place[i:j] - first)).to_pylist()]
                want = digest.slice(i, j - i).to_pylist()
                good = [k for k, t in enumerate(texts) if xxhash.xxh3_128_digest(t.encode()) == want[k]]
                yield from _encode(tokenizer, [texts[k] for k in good], [want[k] for k in good])
            first += batch.num_rows

    # doc_id is read too, so that this reading has the plan of the first
    return docs.select("doc_id", "text").mapInArrow(lambda batches: run(b.select([1]) for b in batches), _COUNTS)


def gathered(docs: DataFrame, missing: DataFrame, n: int, tokenizer: Tokenizer) -> DataFrame:
    """(digest, n_tokens) of `missing` (digest), n of them: texts are shuffled by digest and each distinct one is encoded."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [normalised(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(digested(own), pa.binary()), pa.array(own, pa.large_string()).cast(pa.string())], ["digest", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # equal digests meet in one partition
        for batch in batches:
            digest = batch.column(0).to_pylist()
            fresh = [i for i, d in enumerate(digest) if not (d in seen or seen.add(d))]
            yield from _encode(tokenizer, batch.column(1).take(pa.array(fresh, pa.int64())).to_pylist(), [digest[i] for i in fresh])

    rows = docs.select("text").mapInArrow(texts, "digest binary, text string").join(small(missing, n), "digest", "left_semi")
    return rows.repartition("digest").mapInArrow(encode, _COUNTS)


def fill(docs: DataFrame, cache: str, tokenizer: Tokenizer, known: DataFrame) -> None:
    """Append to the cache the counts of the distinct texts whose digests are not in it."""
    tokenizer = tokenizer.loaded()
    at, held = f"{cache}/{tokenizer.version}", read_cache(docs, cache, tokenizer.version)
    wanted = known.groupBy("digest").agg(F.min(F.struct("part", "at")).alias("one")).select("digest", "one.part", "one.at")
    missing = stored(wanted if held is None else wanted.join(held, "digest", "left_anti"), "missing")
    if missing.isEmpty():
        return
    made = stored(in_place(docs, missing, tokenizer), "encoded")
    made.write.mode("append").parquet(at)
    left = stored(missing.select("digest").join(made.select("digest"), "digest", "left_anti"), "left")
    n = left.count()
    if n:
        gathered(docs, left, n, tokenizer).write.mode("append").parquet(at)


def token_counts(docs: DataFrame, cache: str | None = None, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(doc_id, digest, n_tokens) of every row; cache is a folder that all executors share, a fresh one by default."""
    tokenizer = (tokenizer or Tokenizer()).loaded()
    cache = cache or f"{shared_folder(docs.sparkSession)}/token-cache-{uuid.uuid4().hex}"
    known = stored(digests(docs), "digests")
    fill(docs, cache, tokenizer, known)
    counts = read_cache(docs, cache, tokenizer.version)
    if counts is None:  # no documents and no cache
        return known.select("doc_id", F.lower(F.hex("digest")).alias("digest"), F.lit(0).cast("bigint").alias("n_tokens"))
    return known.join(counts, "digest").select("doc_id", F.lower(F.hex("digest")).alias("digest"), "n_tokens")


def brute_force(texts: list[str | None], tokenizer: Tokenizer) -> np.ndarray:
    """The number of tokens of each text, one by one."""
    count = tokenizer.counter()
    return np.array([count([normalised(t)])[0] for t in texts], np.int64)
