"""Groups of alike nodes: connected components of the pairs that share a band's key and agree in enough registers.

A node's sig holds the last 16 bits of each of its registers, its bands the keys of banding.  A pair is a
candidate if it shares a key and its registers' agreement, corrected for chance, is at least `low`; from `high` on it is
alike, and between the two `verify` decides.

* Heads: each bucket's members are compared with one drawn member (see `bucketed` for buckets of a third of all nodes).
* Rest: of the buckets that still hold several components, those of at most BLOCK members are compared in blocks, each
  member outside the bucket's largest component with all members.  Members of larger buckets are compared with those
  that share a rare register: of two sets that agree in k of m registers, the m - k + 1 rarest registers have one in
  common, so none is missed, and what a passage lends to a million unlike documents is passed over.  Members whose
  rarest registers are frequent all the same go to blocks of all such members.
* Between `low` and `high` the likeliest pair of a node and a component is verified first, and then what is still apart.

No pair is passed over but for pairs whose ends are connected already.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, small, stored

#: Buckets of more members are compared by rare registers.
BLOCK = 2048
#: A register that more nodes share is frequent.
FREQUENT = 256
#: A key that HOT nodes of one in SAMPLED have is hot.
SAMPLED, HOT = 64, 32
CHANCE = 2.0**-16
#: Comparisons of single registers that are held at a time.
_HELD = 1 << 23

Verify = Callable[[DataFrame], DataFrame]


def low_words(sig: np.ndarray) -> pa.Array:
    """The registers' last 16 bits, one binary value for each row."""
    data = np.ascontiguousarray((sig & np.uint64(0xFFFF)).astype(np.uint16)).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * sig.shape[1]), len(sig), [None, pa.py_buffer(data)]).cast(pa.binary())


def registers(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, width)


def corrected(share: np.ndarray) -> np.ndarray:
    return (share - CHANCE) / (1 - CHANCE)


def estimates(pairs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """pairs (a, b) with the corrected share of registers that agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = registers(batch.column(2), width), registers(batch.column(3), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(corrected((x == y).mean(axis=1)))], ["a", "b", "alike"])

    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    pairs = stored(pairs, "pairs")
    return small(pairs, pairs.count()).join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint, alike double")


def buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose first column is sorted, cut anew so that each holds whole runs of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        held.append(batch)
        if key[-1] == held[0].column(0)[0].as_py():
            continue
        cut = int(np.searchsorted(key, key[-1]))
        held[-1] = batch.slice(0, cut)
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def crossing(sig: np.ndarray, root: np.ndarray, low: float, high: float, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, alike) of rows in different components that are alike enough.

    Of pairs from `high` on only those that join components anew are given; of those below, the ones still apart after
    that, with `best` the likeliest alone for each row and component.
    """
    n, width = sig.shape
    comp = np.unique(root, return_inverse=True)[1]
    minor = np.flatnonzero(comp != np.bincount(comp).argmax())
    step = max(1, _HELD // (n * width))
    made: list[tuple[int, int, float]] = []
    open_: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(0, len(minor), step):
        rows = minor[k : k + step]
        like = corrected((sig[rows][:, None] == sig[None]).mean(axis=2))
        like[comp[rows][:, None] == comp[None]] = -1
        for r in np.flatnonzero((like >= high).any(axis=1)):
            i, js = rows[r], np.flatnonzero(like[r] >= high)
            touched, first = np.unique(comp[js], return_index=True)
            fresh = touched != comp[i]
            made += [(i, js[f], like[r, js[f]]) for f in first[fresh]]
            comp[np.isin(comp, touched[fresh])] = comp[i]
        r, j = np.nonzero((like >= low) & (like < high))
        open_.append((rows[r], j, like[r, j]))
    i, j, x = (np.concatenate(p) for p in zip(*open_, strict=True)) if open_ else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    apart = comp[i] != comp[j]
    i, j, x = i[apart], j[apart], x[apart]
    if best and len(i):
        order = np.lexsort((-x, comp[j], i))
        i, j, x = i[order], j[order], x[order]
        new = np.append(True, (i[1:] != i[:-1]) | (comp[j[1:]] != comp[j[:-1]]))
        i, j, x = i[new], j[new], x[new]
    a, b, y = (np.array(p) for p in zip(*made, strict=True)) if made else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return np.concatenate([a, i]).astype(np.int64), np.concatenate([b, j]).astype(np.int64), np.concatenate([y, x])


def bucketed(bands: DataFrame, sets: bool = False) -> DataFrame:
    """Those rows of bands (node, key, ...) that share their key with others, with `size`, their bucket's, and `head`, one of its nodes.

    With `sets`, also `members`: a digest of the bucket's set of nodes.

    Buckets are measured where a single shuffle takes them, but for those that a sample of the nodes shows to be hot:
    their counts are aggregated before they move and joined, so that a bucket may hold a third of all nodes.  The
    sample decides on the way alone, never on the result.
    """
    head = F.min_by("node", F.struct(F.xxhash64("node"), "node"))
    some = bands.where(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(SAMPLED)) == 0)
    hot = stored(some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("key"), "hot")
    n = hot.count()
    per = Window.partitionBy("key")
    facts = {"size": F.count("*"), "head": head} | ({"members": F.bit_xor(F.xxhash64("node"))} if sets else {})

    def measured(rows: DataFrame) -> DataFrame:
        return rows.withColumns({name: fact.over(per) for name, fact in facts.items()}).where("size > 1")

    if not n:
        return measured(bands)
    warm = bands.join(small(hot, n), "key", "left_semi")
    sizes = warm.groupBy("key").agg(*[fact.alias(name) for name, fact in facts.items()])
    return measured(bands.join(small(hot, n), "key", "left_anti")).unionByName(warm.join(small(sizes, n), "key").where("size > 1"))


def signed(sigs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, sig) of `nodes`, which may repeat, from sigs (node, sig), which may repeat too."""
    active = stored(nodes.select("node").distinct(), "active")
    return stored(sigs.select("node", "sig").join(small(active, active.count()), "node", "left_semi").groupBy("node").agg(F.first("sig").alias("sig")), "signed")


def _blocks(rows: DataFrame, width: int, low: float, high: float, best: bool) -> DataFrame:
    """The crossing pairs (a, b, alike) within each key of rows (key, node, root, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in buckets(batches):
            key, node, root = (batch.column(k).to_numpy() for k in range(3))
            sig = registers(batch.column(3), width)
            at = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            for s, e in zip(at[:-1], at[1:], strict=True):
                i, j, like = crossing(sig[s:e], root[s:e], low, high, best)
                if len(i):
                    u, v = node[s + i], node[s + j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(like)], ["a", "b", "alike"])

    return rows.select("key", "node", "root", "sig").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a bigint, b bigint, alike double")


def rare_pairs(members: DataFrame, width: int, low: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, rest) of members (node, root, sig): pairs (a, b) in different components that share a rare register
    among their rarest, and the members whose rarest registers hold a frequent one."""
    need = math.ceil((low * (1 - CHANCE) + CHANCE) * width - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(width, dtype=np.int64) << 16
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                token = (registers(part.column(2), width).astype(np.int64) | place).ravel()
                of = pa.array(np.repeat(np.arange(part.num_rows), width))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(token)], ["node", "root", "token"])

    tokens = stored(members.select("node", "root", "sig").mapInArrow(run, "node bigint, root bigint, token bigint"), "tokens")
    common = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    per = Window.partitionBy("node")
    mine = tokens.join(common, "token").withColumn("shared", F.count("*").over(per)).withColumn("k", F.row_number().over(per.orderBy("f", "token")))
    prefix = stored(mine.where(F.col("k") <= F.lit(width - need + 1) - (F.lit(width) - F.col("shared"))).select("node", "root", "token", "f"), "prefix")
    rare = prefix.where(F.col("f") <= FREQUENT)
    other = rare.select(F.col("node").alias("b"), F.col("root").alias("to"), "token")
    pairs = rare.select(F.col("node").alias("a"), F.col("root").alias("of"), "token").join(other, "token").where("a < b AND of != to").select("a", "b").distinct()
    often = prefix.where(F.col("f") > FREQUENT).select("node").distinct()
    return pairs, members.join(often, "node", "left_semi")


def _tiles(members: DataFrame) -> DataFrame:
    """members (node, root, sig) as rows with a key: each two of which one is outside the largest component share a key."""
    n = members.count()
    if not n:
        return members.withColumn("key", F.lit(0).cast("bigint"))
    main = members.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").first()["root"]
    minor = members.where(F.col("root") != main)
    half = BLOCK // 2
    across, down = math.ceil(n / half), max(1, math.ceil(minor.count() / half))
    h = F.xxhash64("node", F.lit("tile"))
    left = minor.withColumn("i", F.pmod(h, F.lit(down))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = members.withColumn("j", F.pmod(h, F.lit(across))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    return left.unionByName(right).withColumn("key", (F.col("i") * across + F.col("j")).cast("bigint"))


def connected(nodes: DataFrame, sigs: DataFrame, width: int, low: float, high: float, verify: Verify | None = None) -> DataFrame:
    """(node, root) of the nodes (node, bands) that are alike to others: root is the least node of the component.

    sigs has (node, sig) of all nodes, also more than once.
    """
    bands = nodes.select("node", F.explode("bands").alias("key"))
    shared = stored(bucketed(bands), "shared")
    nodes = signed(sigs, shared)  # of those that share a key at all, so that joins move no others
    pairs = shared.where("node != head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    found = stored(estimates(pairs, nodes, width).where(F.col("alike") >= low), "heads")
    tested = found.select("a", "b")
    edges = found.where(F.col("alike") >= high).select("a", "b")
    if verify:
        edges = edges.unionByName(verify(found.where(F.col("alike") < high).select("a", "b")))
    roots = stored(components(edges), "roots")
    out = _settled(shared, nodes, roots, tested, width, low, high, verify)
    drop(shared, nodes, found)
    return out


def _settled(shared: DataFrame, nodes: DataFrame, roots: DataFrame, tested: DataFrame, width: int, low: float, high: float, verify: Verify | None) -> DataFrame:
    """roots, with what the buckets (key, node) in shared that hold several components join, but for the pairs tested."""
    best = verify is not None
    while True:
        rooted = shared.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        live = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x != y").select("key", "n")
        rest = stored(rooted.join(live, "key"), "rest")
        few = _blocks(small(rest.where(F.col("n") <= BLOCK), rest.count()).join(nodes, "node"), width, low, high, best)
        many = None
        if not rest.where(F.col("n") > BLOCK).isEmpty():
            many = stored(rest.where(F.col("n") > BLOCK).select("node", "root").distinct().join(nodes, "node"), "members")
            close, often = rare_pairs(many, width, low)
            few = few.unionByName(estimates(close, many, width).where(F.col("alike") >= low)).unionByName(_blocks(_tiles(stored(often, "often")), width, low, high, best))
        found = stored(few.groupBy("a", "b").agg(F.max("alike").alias("alike")), "crossing")
        drop(rest, many)
        roots = _merged(roots, found.where(F.col("alike") >= high).select("a", "b"))
        if not verify:
            return roots
        apart = stored(_apart(found.where(F.col("alike") < high), roots), "apart")
        if apart.isEmpty():
            return roots
        doubt = stored(apart.join(tested, ["a", "b"], "left_anti"), "doubt")
        if not doubt.isEmpty():
            tested = tested.unionByName(doubt.select("a", "b"))
            roots = _merged(roots, verify(doubt.select("a", "b")))
        if not best:
            return roots
        best = False


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    of = roots.select(F.col("node").alias("a"), F.col("root").alias("x"))
    to = roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
    return pairs.join(of, "a", "left").join(to, "b", "left").where("coalesce(x, a) != coalesce(y, b)").drop("x", "y")


def _merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of the components that roots and edges (a, b) make together; only the roots are linked anew."""
    of = roots.select(F.col("node").alias("a"), F.col("root").alias("x"))
    to = roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
    ends = stored(edges.join(of, "a", "left").join(to, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a != b"), "ends")
    if ends.isEmpty():
        return roots
    new = stored(components(ends).select(F.col("node").alias("root"), F.col("root").alias("top")), "merged")
    known = roots.join(new, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = new.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return stored(known.unionByName(fresh), "roots")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in an edge (a, b): root is the least node that it is connected with.

    Alternating stars: each round links a node's larger neighbours, then its smaller ones, to the least of them, and
    the number of rounds grows with the logarithm of the longest path.  Each round is written to the shared folder.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    e = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "large")
        drop(e)
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(m, "u")
        e = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(m.select("u", F.col("m").alias("v"))).distinct()
        e = stored(e, "small")
        drop(large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", F.col("v").alias("root")).distinct())
        mark = now
