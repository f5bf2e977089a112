"""Related-document packing: a nearest-neighbour graph, greedy low-degree-first paths, and windows filled along them.

Texts are read as words of letters and digits in lower case (in scripts without spaces between words, each character is
one).  Documents are related if they share passages: their similarity is the Jaccard similarity of their runs of
SHINGLE words, estimated by BINS one-permutation minima.  KEYS of them are each a key of its own, so that one equal minimum
makes a candidate (a pair at 0.05 is found with probability 0.87, one at 0.1 with 0.99).  Equal word sequences are one
node.  Of the nodes that share a key all pairs are compared, once for all keys of the same nodes.  Buckets of more than LEAF are compared in tiles of about
TILE by TILE nodes; large buckets linked by common nodes are taken as one group where that makes fewer pairs than each
bucket alone.  Each node keeps its NEAREST neighbours, the nearest ones of all that it shares a key with.

In each connected component a path starts at the unvisited node of lowest degree and goes on to the most similar
unvisited neighbour until there is none; then the next path starts.  A component is walked whole, along all its edges,
however large it is: in one task, whose memory grows with the component.

Paths are laid end to end: components by language, source and hash, in each its paths in the order of their start.
The row of documents is cut into windows of WINDOW tokens (words between white space); a document that crosses a
window's end goes on in the next, so every token of every document is in exactly one window, and only the last window
is not full.

Defined results: texts without tokens (null, empty, blank) take no place and give no rows.  Texts of marks alone are
nodes without neighbours.  Null doc_id, lang and source are values like others.  Repeated rows (of one doc_id and one
word sequence) are all packed, each next one in a further pass over the paths, so that copies don't meet in a window.  Ties
are broken by hash and then doc_id.  Columns beside doc_id, text, lang and source don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MARKS, SPACE, Words, chunks, drop, mix64, small, stored, text_buffers
from .groups import bucketed, buckets, components, corrected, low_words, registers, signed
from .neardup import shingle_keys
from .sketch import band_keys, lists, min_hashes

WINDOW = 2048
#: Words in a run, minima of a text, and how many of them are keys.
SHINGLE, BINS, KEYS = 5, 64, 40
#: How many neighbours are kept of each node.
NEAREST = 8
#: Buckets of more nodes than LEAF are compared in tiles of about TILE nodes a side.
LEAF, TILE = 1024, 4096


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n, node, sig, bands) of the rows with tokens; without words, node is null and so are its sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            for i, j in chunks(offsets):
                n, off = j - i, offsets[i : j + 1]
                w = Words(data, off, MARKS, alone=True)
                inside = ~SPACE[w.buf]
                begin = inside.copy()
                begin[1:] &= ~inside[:-1]
                inner = w.offsets[:-1][w.offsets[:-1] < len(w.buf)]
                begin[inner] = inside[inner]
                tokens = np.diff(np.searchsorted(np.flatnonzero(begin), w.offsets))
                first = np.cumsum(w.count) - w.count
                place = np.arange(len(w.hash)) - np.repeat(first, w.count)
                digest = np.zeros(n, np.uint64)
                has = np.flatnonzero(w.count)
                sig = np.zeros((n, BINS), np.uint64)
                if len(has):
                    spread = w.hash * (mix64(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1))
                    digest[has] = mix64(np.add.reduceat(spread, first[has]) ^ w.count[has].astype(np.uint64))
                    key, begins = shingle_keys(w, place, SHINGLE)
                    sig = min_hashes(n, w.doc[begins], key[begins], BINS)
                keep = np.flatnonzero(tokens)
                bare = w.count[keep] == 0
                one = batch.slice(i, n).take(pa.array(keep)).select([0, 1, 2])
                sigs, keys = low_words(sig[keep]), lists(band_keys(sig[keep], KEYS, 1))
                if bare.any():
                    worded = pa.array(np.where(bare, None, np.arange(len(keep))), pa.int64())
                    sigs, keys = sigs.take(worded), keys.take(worded)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array(tokens[keep], pa.int64()), pa.array(digest[keep].view(np.int64), mask=bare), sigs, keys], ["doc_id", "lang", "source", "n", "node", "sig", "bands"])

    kind = dict(docs.dtypes)
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, f"doc_id {kind['doc_id']}, lang {kind['lang']}, source {kind['source']}, n bigint, node bigint, sig binary, bands array<bigint>")


def nearest_in(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, alike): of each row its NEAREST other rows.  Of equally near ones those that follow are taken, round and round."""
    n, parts = len(sig), []
    step = max(1, (1 << 22) // (n * BINS))
    for k in range(0, n, step):
        block = sig[k : k + step]
        rows, col = np.arange(k, k + len(block))[:, None], np.arange(n)[None, :]
        like = corrected((block[:, None] == sig[None]).mean(axis=2))
        order = like - ((col - rows) % n) / n * 1e-6
        order[np.arange(len(block)), rows[:, 0]] = -9
        top = np.argpartition(-order, min(NEAREST, n - 1) - 1, axis=1)[:, : min(NEAREST, n - 1)]
        parts.append((np.repeat(rows[:, 0], top.shape[1]), top.ravel(), np.take_along_axis(like, top, 1).ravel()))
    a, b, like = (np.concatenate(p) for p in zip(*parts, strict=True))
    good = like > 0
    return a[good], b[good], like[good]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, alike): of rows (key, node, sig), sorted by key, each node's nearest ones in its bucket."""
    for batch in buckets(batches):
        key, node, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy(), registers(batch.column(2), BINS)
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        few = np.repeat(size <= NEAREST + 1, size)  # all pairs, many buckets at a time
        parts = []
        for d in range(1, NEAREST + 1):
            at = np.flatnonzero((key[d:] == key[:-d]) & few[d:])
            for k in range(0, len(at), 8192):
                left = at[k : k + 8192]
                like = corrected((sig[left] == sig[left + d]).mean(axis=1))
                parts += [(node[left], node[left + d], like), (node[left + d], node[left], like)]
        for i, n in zip(begin[size > NEAREST + 1].tolist(), size[size > NEAREST + 1].tolist(), strict=True):
            a, b, like = nearest_in(sig[i : i + n])
            parts.append((node[i + a], node[i + b], like))
        if parts:
            a, b, like = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(like.round(6))], ["u", "v", "alike"])


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many registers of each row of x and each row of y agree."""
    xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    out = np.zeros((len(x), len(y)), np.uint8)
    for k in range(0, len(x), 64):
        part = out[k : k + 64]
        for one, other in zip(xt[:, k : k + 64], yt, strict=True):
            part += one[:, None] == other[None]
    return out


def _highest(agree: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's NEAREST highest values above 0.  Of equal ones those after column row + offset are taken, round and round."""
    n, parts, most = agree.shape[1], [], min(NEAREST, agree.shape[1])
    for k in range(0, len(agree), 256):
        block = agree[k : k + 256].astype(np.float32)
        rows = np.arange(k, k + len(block))[:, None]
        top = np.argpartition(((np.arange(n)[None] - rows - offset) % n).astype(np.float32) / n - block, most - 1, axis=1)[:, :most]
        parts.append((np.repeat(rows[:, 0], most), top.ravel()))
    row, col = (np.concatenate(p) for p in zip(*parts, strict=True))
    good = agree[row, col] > 0
    return row[good], col[good]


def _near_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, alike): of rows (key, side, node, sig), sorted, each node's nearest ones on its tile's other side, or in a tile of one side."""
    for batch in buckets(batches):
        key, side, node = (batch.column(k).to_numpy() for k in range(3))
        sig = registers(batch.column(3), BINS)
        at = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            cut = s + int(np.searchsorted(side[s:e], 1))
            if s < cut < e:
                agree = agreement(sig[s:cut], sig[cut:e])
                (a, b), (c, d) = _highest(agree, 0), _highest(np.ascontiguousarray(agree.T), 0)
                u, v, like = np.append(s + a, cut + c), np.append(cut + b, s + d), np.append(agree[a, b], agree[d, c])
            else:
                agree = agreement(sig[s:e], sig[s:e])
                np.fill_diagonal(agree, 0)
                a, b = _highest(agree, 1)
                u, v, like = s + a, s + b, agree[a, b]
            yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v]), pa.array(corrected(like / BINS).round(6))], ["u", "v", "alike"])


def _in_tiles(large: DataFrame, sig: DataFrame) -> DataFrame:
    """(u, v, alike): the nearest ones of the nodes of large buckets (key, node, size), over all pairs of each bucket."""
    least = stored(large.groupBy("node").agg(F.min("key").alias("first")), "least")
    links = large.join(least, "node").where("key != first").select(F.col("first").alias("a"), F.col("key").alias("b")).distinct()
    of = stored(components(links).select(F.col("node").alias("key"), "root"), "linked")
    member = stored(least.join(of.withColumnRenamed("key", "first"), "first", "left").select(F.coalesce("root", "first").alias("key"), "node"), "member")
    single = large.select("key", "size").distinct().join(of, "key", "left").withColumn("root", F.coalesce("root", "key"))
    work = single.groupBy("root").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("apart"))
    groups = member.groupBy("key").agg(F.count("*").alias("n")).join(work.withColumnRenamed("root", "key"), "key")
    whole = stored(groups.where(F.col("n").cast("double") * F.col("n") <= F.col("apart")).select("key", "n"), "whole")
    alone = single.join(whole.select(F.col("key").alias("root")), "root", "left_anti").select("key")
    sets = member.join(whole, "key").select("key", "node", "n").unionByName(large.join(alone, "key", "left_semi").select("key", "node", F.col("size").alias("n")))
    across = F.ceil(F.col("n") / TILE)
    own = sets.withColumn("own", F.pmod(F.xxhash64("node", F.lit("tile")), across)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), across - 1)))
    tiles = own.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node")
    return tiles.join(sig, "node").select("key", "side", "node", "sig").repartition("key").sortWithinPartitions("key", "side", "node").mapInArrow(_near_tiles, "u bigint, v bigint, alike double")


def member_sets(nodes: DataFrame) -> DataFrame:
    """(key, node, size): the buckets of nodes (node, bands), those of the same nodes as one: near copies share most of their keys.

    Sets whose digests meet by chance are compared together, which loses no pair.
    """
    shared = bucketed(nodes.select("node", F.explode("bands").alias("key")), sets=True)
    return shared.select(F.xxhash64("size", "members").alias("key"), "node", "size").repartition("node").dropDuplicates(["key", "node"])


def neighbours(nodes: DataFrame, sigs: DataFrame) -> DataFrame:
    """(u, v, alike), u < v: the edges of the nearest-neighbour graph of nodes (node, bands) with sigs (node, sig), which may repeat."""
    shared = stored(member_sets(nodes), "shared")
    sig = signed(sigs, shared)
    found = shared.where(F.col("size") <= LEAF).join(sig, "node").select("key", "node", "sig").repartition("key").sortWithinPartitions("key", "node").mapInArrow(_near, "u bigint, v bigint, alike double")
    large = shared.where(F.col("size") > LEAF)
    if not large.isEmpty():
        found = found.unionByName(_in_tiles(large, sig))
    # a node has NEAREST neighbours at most from each of its buckets and tiles
    by_node = found.groupBy("u").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("alike")).alias("far"), F.xxhash64("u", "v").alias("h"), "v"))), 1, NEAREST).alias("near"))
    nearest = by_node.select("u", F.explode("near").alias("n")).select("u", "n.v", (-F.col("n.far")).alias("alike"))
    graph = stored(nearest.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("alike").alias("alike")), "graph")
    drop(shared, sig)
    return graph


def walked(begin: np.ndarray, to: np.ndarray, alike: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, path) in the order of the walk: paths start at the next unvisited node of `order`.

    Nodes are numbers from 0 on; node u's neighbours are to[begin[u] : begin[u + 1]].  Of equally similar ones that of
    lowest degree, then least number, is taken.  Each node's neighbours are read once.
    """
    n, at = len(order), 0
    steps, path = np.zeros(n, np.int32), np.zeros(n, np.int32)
    seen, first, near, like, out, of = bytearray(n), memoryview(begin), memoryview(to), memoryview(alike), memoryview(steps), memoryview(path)
    number = -1
    for k in range(0, n, 1 << 16):
        for u in order[k : k + (1 << 16)].tolist():
            if seen[u]:
                continue
            number += 1
            while u >= 0:
                seen[u] = 1
                out[at], of[at] = u, number
                at += 1
                best, most, degree = -1, -1.0, 0
                for j in range(first[u], first[u + 1]):
                    v = near[j]
                    if seen[v] or like[j] < most:
                        continue
                    d = first[v + 1] - first[v]
                    if like[j] > most or (d, v) < (degree, best):
                        best, most, degree = v, like[j], d
                u = best
    return steps, path


def walk(edges: dict[int, list[tuple[float, int]]]) -> list[tuple[int, int]]:
    """(node, path) in the order of the walk: paths start at the unvisited node of lowest degree, then least number."""
    nodes = np.array(sorted(edges), np.int64)
    begin = np.append(0, np.cumsum([len(edges[u]) for u in nodes.tolist()]))
    ends = [e for u in nodes.tolist() for e in edges[u]]
    to = np.searchsorted(nodes, np.array([v for _, v in ends], np.int64)).astype(np.int32)
    steps, path = walked(begin, to, np.array([x for x, _ in ends], float), np.argsort(np.diff(begin), kind="stable"))
    return list(zip(nodes[steps].tolist(), path.tolist(), strict=True))


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, path, place): of rows (root, u, v, alike), each edge from both its ends, sorted by u, the walk of each root's nodes."""
    nodes, roots, counts, to, alike = [], [], [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        root, u, v, like = (c.to_numpy() for c in batch.columns)
        new = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        nodes.append(u[new])
        roots.append(root[new])
        counts.append(np.diff(np.append(new, len(u))))
        to.append(v.copy())
        alike.append(like.astype(np.float32))  # six digits, which this keeps apart
    if not nodes:
        return
    node, root, count = (np.concatenate(x) for x in (nodes, roots, counts))
    new = np.append(True, node[1:] != node[:-1])  # a node's edges may go on in the next batch
    begin = np.append((np.cumsum(count) - count)[new], count.sum())
    node, root = node[new], root[new]
    for k, v in enumerate(to):
        to[k] = np.searchsorted(node, v).astype(np.int32)
    steps, path = walked(begin, np.concatenate(to), np.concatenate(alike), np.lexsort((np.diff(begin), root)))
    root = root[steps]
    first = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
    for k in range(0, len(steps), 1 << 16):
        part = slice(k, k + (1 << 16))
        own = first[np.searchsorted(first, np.arange(k, min(k + (1 << 16), len(steps))), side="right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(node[steps[part]]), pa.array(root[part]), pa.array((path[part] - path[own]).astype(np.int64)), pa.array(np.arange(k, k + len(own)) - own)], ["node", "root", "path", "place"])


def paths(graph: DataFrame) -> DataFrame:
    """(node, root, path, place): each node's component in graph (u, v, alike), and its path and place in the component's walk."""
    roots = stored(components(graph.select(F.col("u").alias("a"), F.col("v").alias("b"))), "roots")
    inside = graph.join(roots.withColumnRenamed("node", "u"), "u")
    ends = inside.select("root", F.explode(F.array(F.struct("u", "v", "alike"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "alike"))).alias("end")).select("root", "end.u", "end.v", "end.alike")
    return ends.repartition("root").sortWithinPartitions("u").mapInArrow(_walks, "node bigint, root bigint, path bigint, place bigint")


def _same(left: str, right: str, *keys: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def packed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, at, doc_id, first, n, path): n tokens of doc_id from token `first` on stand in the window from `at` on.

    path is a number that the documents of one path share.
    """
    rows = stored(sketches(docs), "sketches")
    nodes = stored(rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("lang", "source")).alias("of"), F.first("bands").alias("bands")), "nodes")
    graph = neighbours(nodes, rows.where("node IS NOT NULL"))
    steps = stored(paths(graph), "paths")
    heads = steps.join(nodes.select("node", "of"), "node").groupBy("root").agg(F.min("of").alias("of"))
    along = steps.join(heads, "root").select("node", "root", "path", "place", "of")
    own = rows.select("doc_id", "lang", "source", "n", F.coalesce("node", F.xxhash64("doc_id", F.lit("bare"))).alias("node")).groupBy("doc_id", "lang", "source", "n", "node").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("node", "doc_id").orderBy("n", F.asc_nulls_first("lang"), F.asc_nulls_first("source")).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("round", F.coalesce(F.sum("copies").over(before), F.lit(0)) + 1).withColumn("round", F.explode(F.sequence("round", F.col("round") + F.col("copies") - 1)))
    placed = own.join(along, "node", "left").select(
        "doc_id", "n", "node", "round", F.coalesce("root", "node").alias("root"), F.coalesce("path", F.lit(0)).alias("path"), F.coalesce("place", F.lit(0)).alias("place"),
        F.coalesce("of.lang", F.when(F.col("root").isNull(), F.col("lang"))).alias("lang"), F.coalesce("of.source", F.when(F.col("root").isNull(), F.col("source"))).alias("source"),
    )
    placed = placed.withColumn("h", F.xxhash64("root")).withColumn("range", F.shiftrightunsigned("h", 52)).withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.lit(4096)))
    # Exact offsets in steps: rows within units (a node's rows, in 4096 parts, for copies may be a third of all), units
    # within ranges of hashes, ranges within sources; the one window without partitions runs over as many rows as there are sources.
    unit = Window.partitionBy("round", "lang", "source", "node", "sub")
    inside = unit.orderBy(F.asc_nulls_first("doc_id"), "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(placed.withColumn("skip", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("all", F.sum("n").over(unit)), "placed")
    drop(rows, nodes, graph, steps)
    units = placed.where("skip = 0")
    ranges = stored(units.groupBy("round", "lang", "source", "range").agg(F.sum("all").alias("n")), "ranges")
    leaf = Window.orderBy("round", F.asc_nulls_first("lang"), F.asc_nulls_first("source")).rowsBetween(Window.unboundedPreceding, -1)
    leaves = ranges.groupBy("round", "lang", "source").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(leaf), F.lit(0)))
    inner = Window.partitionBy("round", "lang", "source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    within = ranges.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    starts = stored(within.alias("r").join(leaves.alias("l"), _same("r", "l", "round", "lang", "source")).select("r.round", "r.lang", "r.source", "r.range", (F.col("l.before") + F.col("r.within")).alias("before")), "starts")
    run = Window.partitionBy("round", "lang", "source", "range").orderBy("h", "root", "place", "node", "sub").rowsBetween(Window.unboundedPreceding, -1)
    running = units.withColumn("within", F.coalesce(F.sum("all").over(run), F.lit(0)))
    at = stored(
        running.alias("p").join(small(starts, starts.count(), 100_000).alias("s"), _same("p", "s", "round", "lang", "source", "range"))
        .select("p.doc_id", "p.n", "p.root", "p.path", (F.col("s.before") + F.col("p.within")).alias("start"), "p.round", "p.lang", "p.source", "p.node", "p.sub", (F.col("p.all") > F.col("p.n")).alias("more")), "units",
    )
    others = placed.where("skip > 0").alias("p").join(at.where("more").alias("s"), _same("p", "s", "round", "lang", "source", "node", "sub")).select("p.doc_id", "p.n", "p.root", "p.path", (F.col("s.start") + F.col("p.skip")).alias("start"))
    laid = at.select("doc_id", "n", "root", "path", "start").unionByName(others).select("doc_id", "n", F.xxhash64("root", "path").alias("path"), "start")
    size = F.lit(window)
    spans = F.sequence(F.floor(F.col("start") / size).cast("bigint"), F.floor((F.col("start") + F.col("n") - 1) / size).cast("bigint"))
    cut = laid.withColumn("window", F.explode(spans))
    begin, end = F.greatest(F.col("start"), F.col("window") * size), F.least(F.col("start") + F.col("n"), (F.col("window") + 1) * size)
    return cut.select("window", (begin - F.col("window") * size).alias("at"), "doc_id", (begin - F.col("start")).alias("first"), (end - begin).alias("n"), "path")
