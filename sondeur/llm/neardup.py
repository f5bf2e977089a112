"""Near-duplicate search by ProbMinHash over weighted word shingles, with banding and verification.

Texts are read as words of letters and digits in lower case; in scripts without spaces between words each character is one.  A document's shingles are its runs of SHINGLE words
(all its words, if it has fewer), each with its count as weight.  Each shingle is a Poisson process whose rate is its
weight; its points fall on M registers and each register keeps the shingle of its earliest point.  A process is
followed only until it passes the latest register, so long documents cost about one point a shingle.  Two registers
agree with the probability Jaccard similarity J_P of the weighted sets.

Equal word sequences fall together first, by digest.  Their representatives are banded, and pairs that share a band's key
and aren't connected yet are compared (see `groups`).  A pair whose estimate lies within MARGIN of the threshold is
verified by the exact J_P of its texts, any other by the estimate over all registers.  Groups are the connected
components of verified pairs.

Defined results: a document without words (null, empty or marks only) or without doc_id is in no group and kept.  Of a
group, one row of the least doc_id is kept, however often it repeats.  Rows of one doc_id with different texts are
judged apart.  Columns beside doc_id and text don't matter.  Word sequences count as equal by 64-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MARKS, Words, chunks, drop, mix64, small, stored, text_buffers
from .groups import connected, low_words
from .sketch import band_keys, lists

SHINGLE = 3
#: Registers, and the bands and rows of keys that some of them make (recall 0.88 at the threshold, 0.98 at 0.6).
M = 128
BANDS, ROWS = 16, 3
#: The probability Jaccard similarity from which two documents count as near copies.
THRESHOLD = 0.5
MARGIN = 0.15


def shingle_keys(w: Words, place: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the run of `size` words that begins at each word (`place` in its text), and where such runs begin."""
    key = w.hash.copy()
    begins = place <= np.repeat(np.maximum(w.count - size, 0), w.count)
    left = np.repeat(w.count, w.count) - place
    for k in range(1, size):
        later = np.zeros(len(key), np.uint64)
        later[:-k or None] = w.hash[k:]
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, later, np.uint64(k)))
    return key, begins


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 40-bit shingle, weight) of each distinct shingle, sorted, and each text's digest (0: no words)."""
    w = Words(data, offsets, MARKS, alone=True)
    n, total = w.n, len(w.hash)
    digest = np.zeros(n, np.int64)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), digest
    first = np.cumsum(w.count) - w.count
    place = np.arange(total) - np.repeat(first, w.count)
    has = np.flatnonzero(w.count)
    spread = w.hash * (mix64(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1))
    sums = mix64(np.add.reduceat(spread, first[has]) ^ mix64(w.count[has].astype(np.uint64)))
    digest[has] = np.where(sums == 0, np.uint64(1), sums).view(np.int64)
    key, begins = shingle_keys(w, place, size)
    packed = (w.doc.astype(np.uint64) << np.uint64(40) | key >> np.uint64(24))[begins]
    packed.sort()
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(packed)))
    packed = packed[at]
    return (packed >> np.uint64(40)).astype(np.int64), packed & np.uint64((1 << 40) - 1), weight, digest


def prob_min_hash(n: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, m: int = M) -> np.ndarray:
    """(n, m) registers: the hash of the element with the earliest point; 0 in sets without elements.

    Rounds follow 1, 2, 4, ... points of each process that can still come before its set's latest register.
    """
    best = np.full(n * m, np.inf)
    sig = np.zeros(n * m, np.uint64)
    key = mix64(element + np.uint64(1))
    scale = 1.0 / weight
    at = np.zeros(len(doc))
    active = np.arange(len(doc))
    step, done = 1, 0
    while len(active):
        k = key[active]
        u = mix64(k[:, None] + np.arange(done + 1, done + step + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log(((u >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) * scale[active, None]
        point = at[active, None] + np.cumsum(gap, axis=1)
        cell = (doc[active, None] * m + (u & np.uint64(4095)).astype(np.int64) % m).ravel()
        p, e = point.ravel(), np.repeat(k, step)
        early = p < best[cell]
        cell, p, e = cell[early], p[early], e[early]
        np.minimum.at(best, cell, p)
        won = best[cell] == p
        sig[cell[won]] = e[won]
        at[active] = point[:, -1]
        latest = best.reshape(n, m).max(axis=1)
        active = active[at[active] < latest[doc[active]]]
        done += step
        step = min(2 * step, 64)
    return sig.reshape(n, m)


def probability_jaccard(a: dict[int, float], b: dict[int, float]) -> float:
    """J_P of two weighted sets, by definition."""
    both = [k for k in a if k in b]
    keys = {*a, *b}
    return sum(1 / sum(max(a.get(x, 0) / a[k], b.get(x, 0) / b[k]) for x in keys) for k in both)


def exact_similarity(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """J_P of two sets given as sorted keys and weights, in O(n log n)."""
    keys = np.union1d(ka, kb)
    a, b = np.zeros(len(keys)), np.zeros(len(keys))
    a[np.searchsorted(keys, ka)] = wa
    b[np.searchsorted(keys, kb)] = wb
    with np.errstate(divide="ignore"):
        ratio = np.where(b > 0, a / np.maximum(b, 1e-300), np.inf)
    order = np.argsort(ratio, kind="stable")
    a, b = a[order], b[order]
    above = np.cumsum(a[::-1])[::-1]
    below = np.cumsum(b) - b
    both = (a > 0) & (b > 0)  # ties of the ratio give the same sum on either side
    return float((1 / (above[both] / a[both] + below[both] / b[both])).sum())


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, sig, bands) of the documents with words: digest, 16 bits of each register, and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                doc, element, weight, digest = weighted_shingles(data, offsets[i : j + 1])
                sig = prob_min_hash(j - i, doc, element, weight)
                has = np.flatnonzero(digest)
                if not len(has):
                    continue
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(has)), pa.array(digest[has]), low_words(sig[has]), lists(band_keys(sig[has], BANDS, ROWS))], ["doc_id", "node", "sig", "bands"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, f"doc_id {kind}, node bigint, sig binary, bands array<bigint>")


def _exact(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) whose texts' J_P reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = text_buffers(batch.column(2)), text_buffers(batch.column(3))
            node, good = batch.column(1).to_numpy(), []
            for i in range(batch.num_rows):
                _, ka, wa, _ = weighted_shingles(da, oa[i : i + 2])
                if not i or node[i] != node[i - 1]:  # the join leaves pairs of one b together
                    _, kb, wb, _ = weighted_shingles(db, ob[i : i + 2])
                good.append(exact_similarity(ka, wa, kb, wb) >= THRESHOLD)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    if pairs.isEmpty():
        return pairs
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", F.col("id").alias("doc_id"), "kept"), "borderline")
    texts = docs.select("doc_id", "text").join(small(ids, ids.count()), "doc_id")
    # Of a repeated doc_id the text with the node's digest counts.
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            right = [weighted_shingles(data, offsets[i : j + 1])[3] for i, j in chunks(offsets)]
            own = np.concatenate(right) == batch.column(0).to_numpy() if right else np.zeros(0, bool)
            yield batch.filter(pa.array(own))

    found = stored(texts.select("node", "text").mapInArrow(digests, "node bigint, text string").dropDuplicates(["node"]), "texts")
    joined = pairs.join(found.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(found.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    out = stored(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint"), "verified")
    drop(ids, found)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, node, group_id, size, copy, keep) of every row of docs with words and a doc_id.

    group_id is the least doc_id of the row's group, size its number of rows; copy counts rows alike in doc_id and text.
    """
    sigs = stored(signatures(docs), "signatures")
    nodes = stored(sigs.groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("kept"), F.first("bands").alias("bands")), "nodes")
    roots = connected(nodes, sigs, M, THRESHOLD - MARGIN, THRESHOLD + MARGIN, lambda pairs: _exact(pairs, docs, nodes))
    by_node = nodes.select("node", "id", "kept").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = by_node.groupBy("root").agg(F.min("id").alias("group_id"), F.sum("kept").alias("size"), F.min_by("node", F.struct("id", "node")).alias("first"))
    of = by_node.select("node", "root").join(groups, "root")
    rows = sigs.groupBy("doc_id", "node").agg(F.count("*").alias("copies"))
    found = (
        rows.join(of, "node")
        .select("doc_id", "node", "group_id", "size", "first", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .select("doc_id", "node", "group_id", "size", "copy", ((F.col("copy") == 1) & (F.col("doc_id") == F.col("group_id")) & (F.col("node") == F.col("first"))).alias("keep"))
    )
    out = stored(found, "groups")
    drop(sigs, nodes, roots)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, with all their columns."""
    found = near_duplicates(docs).select("doc_id", "node", "keep")
    again = stored(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id")), "repeated")
    n = again.count()
    gone = found.groupBy("doc_id").agg(F.max("keep").alias("kept")).where("NOT kept").select(F.col("doc_id").alias("__id"))
    left = docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")
    if not n:
        return left
    # Rows that share a doc_id: judged by their digests as well, and one of equal ones stays.
    once = left.join(small(again, n), F.col("doc_id") == F.col("__id"), "left_anti")
    many = left.join(small(again, n), F.col("doc_id") == F.col("__id"), "left_semi")
    at, names = docs.columns.index("text"), [*docs.columns, "__node"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            own = [weighted_shingles(data, offsets[i : j + 1])[3] for i, j in chunks(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))], names)

    marked = many.mapInArrow(digest, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", __node bigint")
    fine = found.where("keep").select(F.col("doc_id").alias("__id"), F.col("node").alias("__of")).distinct()
    same = marked.join(fine, (F.col("doc_id") == F.col("__id")) & (F.col("__node") == F.col("__of"))).dropDuplicates(["doc_id", "__node"])
    return once.unionByName(same.unionByName(marked.where("__node = 0"), allowMissingColumns=True).select(*docs.columns))
