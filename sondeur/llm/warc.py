"""A deterministic sharded WARC writer.

Pages become WARC 1.1 response records whose HTTP and WARC headers, record ids and digests are made anew from the
content, each its own gzip member.  Records are sorted by URL, page_id and digest.  Files roll by compressed size: the
record whose first compressed byte, counted over all sorted records, falls in the k-th multiple of `roll` bytes is in
file k, so files depend on the pages alone and not on partitions.  Offsets come from a range sort of keys without
payloads; the payload moves once, to the task that writes its files, which are a run of consecutive ones, so that there are at most some thousand tasks.

A file's name ends with its digest.  A task writes it under a temporary name that begins with TEMPORARY and renames it;
the driver then writes the manifest, likewise, as its rows stream in.  What the manifest doesn't list isn't part of the result.
So a reader sees the old set until the manifest is renamed and the new one after; files of the set before are deleted only
then, and nothing that this writer didn't make is touched.  A task that runs again writes the same bytes under the same name.

Defined results: null html is an empty payload.  A null or empty url becomes urn:page:<page_id>; blanks and control
characters in it are percent-encoded.  A null page_id stands as the word null.  Repeated rows are written each, under
one record id, and one task writes all rows that are equal.  A record larger than `roll` ends its file, which holds what
begins before it in the same multiple, and the numbers of the multiples that it covers are left out.  An empty table gives a
manifest without files and no rows.  Columns beside page_id, url and html don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import qualified, small, stored

ROLL = 64 << 20
DATE = "2024-01-01T00:00:00Z"
SOFTWARE = "sondeur"
#: How the names of files that aren't ready begin.
TEMPORARY = ".warc-writing-"
_RECORD = "key binary, page_id string, url string, payload_digest string, size bigint, member binary"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member without time or name."""
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(lines.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def target(url: str | None, page: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"


def record(page: str, url: str | None, html: str | None, date: str = DATE) -> tuple[bytes, str, str, bytes]:
    """(sort key, target, payload digest, gzip member) of a page."""
    payload, uri = (html or "").encode(), target(url, page)
    digest = _sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{uri}\n{page}\n{digest}")
    head = [
        ("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return f"{uri}\0{page:>20}\0{digest}".encode(), uri, digest, _member(head, block)


def opening(number: int, date: str = DATE) -> bytes:
    """The warcinfo record that begins a file; its name depends on the digest, so the record holds its number alone."""
    file = f"part-{number:08d}.warc.gz"
    block = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, file)}>"), ("WARC-Date", date), ("WARC-Filename", file), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return _member(head, block)


def records(pages: DataFrame, date: str = DATE, whole: bool = True) -> DataFrame:
    """(key, page_id, url, payload_digest, size, member) of every page; without `whole`, members are measured and let go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k in range(0, len(ids), 512):
                part = ids[k : k + 512]
                made = [record("null" if i is None else i, u, h, date) for i, u, h in zip(part, batch.column(1).slice(k, 512).to_pylist(), batch.column(2).slice(k, 512).to_pylist(), strict=True)]
                key, uri, digest, member = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part, pa.string()), pa.array(uri), pa.array(digest), pa.array([len(m) for m in member], pa.int64()), pa.array(member if whole else [None] * len(part), pa.binary())], ["key", "page_id", "url", "payload_digest", "size", "member"])

    return pages.select(F.col("page_id").cast("string"), "url", "html").mapInArrow(run, _RECORD)


def first_keys(made: DataFrame, roll: int, tasks: int = 4096) -> list[tuple[bytes, int]]:
    """(key, offset) of the first record of each run of files that one task writes, in order: at most `tasks` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, first = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            sizes, start = batch.column(1).to_numpy(), []
            for key, size in zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True):
                if key != last:
                    last, first = key, at
                start.append(first)  # equal keys, which are in one partition, count from the first of them
                at += size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(sizes), pa.int32()), pa.array(start, pa.int64()), batch.column(1)], ["key", "part", "start", "size"])

    sizes = stored(made.select("key", "size"), "sizes")  # the range sort reads its input twice, to sample it first
    keys = stored(sizes.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "key binary, part int, start bigint, size bigint"), "keys")
    parts = stored(keys.groupBy("part").agg(F.sum("size").alias("n")), "parts")
    n, total = parts.count(), parts.agg(F.sum("n")).first()[0] or 0
    bases = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    each = roll * max(1, -(-total // (roll * tasks)))
    placed = keys.join(small(bases, n), "part").select("key", (F.col("base") + F.col("start")).alias("at"))
    first = placed.groupBy(F.floor(F.col("at") / F.lit(each)).alias("run")).agg(F.min(F.struct("key", "at")).alias("first")).orderBy("run")
    return [(bytes(r["first"]["key"]), r["first"]["at"]) for r in first.collect()]


@dataclass
class _Open:
    """A file being written under a temporary name."""

    system: Any
    folder: str
    run: int
    number: int
    rows: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.temporary = f"{self.folder}/{TEMPORARY}part-{self.run:04d}-{self.number:08d}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.temporary, compression=None)
        self.sha, self.at = hashlib.sha256(), 0

    def put(self, data: bytes) -> int:
        self.stream.write(data)
        self.sha.update(data)
        self.at += len(data)
        return self.at - len(data)

    def close(self) -> pa.RecordBatch:
        self.stream.close()
        digest = self.sha.hexdigest()
        name = f"part-{self.run:04d}-{self.number:08d}-{digest[:16]}.warc.gz"
        self.system.move(self.temporary, f"{self.folder}/{name}")
        page, url, payload, offset, length = zip(*self.rows, strict=True)
        n = len(page)
        return pa.RecordBatch.from_arrays(
            [pa.array(page, pa.string()), pa.array(url, pa.string()), pa.array([name] * n), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(payload, pa.string()), pa.array([self.at] * n, pa.int64()), pa.array([digest] * n)],
            ["page_id", "url", "file", "offset", "length", "payload_digest", "file_bytes", "file_sha256"],
        )


def write_warc(pages: DataFrame, folder: str, roll: int = ROLL, date: str = DATE) -> DataFrame:
    """Write pages to folder; (page_id, url, file, offset, length, payload_digest) of every record."""
    uri = qualified(pages, folder)
    system, root = pafs.FileSystem.from_uri(uri)
    system.create_dir(root, recursive=True)
    # Records are made twice: once for their sizes, and again for the one shuffle that takes them to their files.  That is
    # cheaper on disk than keeping them, and making them is deterministic.
    firsts = first_keys(records(pages, date, whole=False), roll)

    keys = [k for k, _ in firsts]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [bisect_right(keys, k) - 1 for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], ["run", *batch.schema.names])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(uri)
        now, of, at = None, -1, 0
        for batch in batches:
            for run, page, url, digest, member in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 6)), strict=True):
                if run != of:
                    of, at = run, firsts[run][1]
                number = at // roll
                if now is None or (run, number) != (now.run, now.number):
                    if now:
                        yield now.close()
                    now = _Open(system, root, run, number)
                    now.put(opening(number, date))
                now.rows.append((page, url, digest, now.put(member), len(member)))
                at += len(member)
        if now:
            yield now.close()

    kind = dict(pages.dtypes)["page_id"]
    index = "page_id string, url string, file string, offset bigint, length bigint, payload_digest string, file_bytes bigint, file_sha256 string"
    sorted_ = records(pages, date).mapInArrow(place, f"run int, {_RECORD}").repartitionById(max(1, len(firsts)), "run").sortWithinPartitions("run", "key")
    done = stored(sorted_.mapInArrow(write, index), "index")
    commit(done, system, root)
    return done.select(F.expr(f"try_cast(page_id AS {kind})").alias("page_id"), "url", "file", "offset", "length", "payload_digest")


def _listed(system: Any, root: str) -> set[str]:
    """The files of the set that a folder's manifest lists."""
    if system.get_file_info(f"{root}/manifest.json").type == pafs.FileType.NotFound:
        return set()
    with system.open_input_stream(f"{root}/manifest.json", compression=None) as f:
        return {x["file"] for x in json.loads(f.read())}


def commit(index: DataFrame, system: Any, root: str) -> None:
    """Rename a manifest of the files in the index into place, and then delete the files of the set before and of failed attempts."""
    before, listed = _listed(system, root), set()
    files = index.groupBy("file").agg(F.count("*").alias("records"), F.first("file_bytes").alias("bytes"), F.first("file_sha256").alias("sha256")).orderBy("file")
    temporary = f"{root}/{TEMPORARY}manifest.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary, compression=None) as out:
        out.write(b"[")
        for k, r in enumerate(files.toLocalIterator()):  # one partition of files at a time
            listed.add(r["file"])
            out.write((",\n" if k else "\n").encode() + json.dumps(r.asDict()).encode())
        out.write(b"\n]\n")
    system.move(temporary, f"{root}/manifest.json")
    for info in system.get_file_info(pafs.FileSelector(root)):
        if info.is_file and (info.base_name.startswith(TEMPORARY) or info.base_name in before - listed):
            system.delete_file(info.path)
