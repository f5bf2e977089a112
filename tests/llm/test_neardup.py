"""ProbMinHash against its definition, and groups against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from sondeur.llm import groups, neardup
from sondeur.llm.common import text_buffers

from .conftest import prose, table, word


def _shingles(text):
    data, offsets = text_buffers(pa.array([text]))
    _, key, weight, _ = neardup.weighted_shingles(data, offsets)
    return dict(zip(key.tolist(), weight.tolist(), strict=True))


def test_registers_agree_with_probability_jaccard():
    rng = random.Random(3)
    a = {i: rng.randint(1, 5) for i in range(60)}
    b = {i: rng.randint(1, 5) for i in range(20, 80)}
    exact = neardup.probability_jaccard(a, b)
    m = 4000
    doc = np.array([0] * len(a) + [1] * len(b))
    sig = neardup.prob_min_hash(2, doc, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), m)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04
    key = lambda s: (np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)]))
    assert abs(neardup.exact_similarity(*key(a), *key(b)) - exact) < 1e-9


def _edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = word(rng)
    return " ".join(words)


def _brute_groups(rows):
    sets = {i: _shingles(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    pairs = set()
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and sets[i].keys() & sets[j].keys() and neardup.probability_jaccard(sets[i], sets[j]) >= neardup.THRESHOLD:
                pairs.add((i, j))
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}, pairs


def test_groups_against_brute_force(spark):
    rng = random.Random(4)
    rows, nxt = [], 0
    for _ in range(25):
        base = prose(rng, rng.randint(30, 120))
        for k in range(rng.choice([1, 1, 2, 4])):
            rows.append((nxt, base if k == 0 else _edited(rng, base, rng.randint(0, 4)), "en", "s"))
            nxt += 1
    rows += [(nxt + i, prose(rng, rng.randint(5, 80)), "en", "s") for i in range(60)]
    want, pairs = _brute_groups(rows)
    got = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicates(table(spark, rows)).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert pairs and found / len(pairs) >= 0.95
    # nothing is joined that brute force keeps apart
    apart = [(i, j) for i in want for j in want if i < j and got[i] == got[j] and want[i] != want[j]]
    assert not apart


def test_one_of_each_group_stays(spark):
    rng = random.Random(6)
    base = prose(rng, 80)
    rows = [(5, base, "en", "s"), (3, base.upper() + "!!", "en", "s"), (9, _edited(rng, base, 1), "en", "s"), (3, base, "en", "s"), (20, prose(rng, 80), "en", "s"), (21, "", "en", "s"), (22, None, "en", "s")]
    kept = sorted(r["doc_id"] for r in neardup.deduplicated(table(spark, rows)).collect())
    assert kept == [3, 20, 21, 22]


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in groups.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_large_groups_of_copies(spark):
    rng = random.Random(8)
    base = prose(rng, 60)
    rows = [(i, _edited(rng, base, 1), "en", "s") for i in range(1500)]
    got = defaultdict(int)
    for r in neardup.near_duplicates(table(spark, rows, clash=False)).collect():
        got[r["group_id"]] += 1
    assert max(got.values()) >= 1470


def _signed(rng, base, share, n, width=64):
    """Registers of n sets of which each takes about `share` from base and the rest from nowhere else."""
    own = rng.integers(0, 1 << 16, (n, width), dtype=np.uint16)
    return np.where(rng.random((n, width)) < share, base, own)


def test_unlike_members_of_a_large_bucket_are_hardly_compared(spark):
    """10 000 unlike nodes that share a quarter of their registers, and in one bucket all of them: far from all pairs are compared."""
    rng = np.random.default_rng(1)
    n, width = 10_000, 64
    sig = _signed(rng, rng.integers(0, 1 << 16, width, dtype=np.uint16), 0.2, n, width)
    twins = [(k, k + 5000) for k in range(0, 200, 5)]  # alike in six of ten registers
    for a, b in twins:
        own = rng.random(width) < 0.75
        sig[b, own] = sig[a, own]
    rows = [(i, i, sig[i].tobytes()) for i in range(n)]
    members = spark.createDataFrame(rows, "node bigint, root bigint, sig binary")
    pairs, often = groups.rare_pairs(members, width, 0.6)
    found = {tuple(r) for r in pairs.collect()}
    assert set(twins) <= found
    assert len(found) < n * n / 2 / 100 and often.count() < n / 100
    nodes = spark.createDataFrame([(i, sig[i].tobytes(), [1]) for i in range(n)], "node bigint, sig binary, bands array<bigint>")
    got = {r["node"]: r["root"] for r in groups.connected(nodes, nodes, width, 0.6, 0.6).collect()}
    assert {(a, b) for a, b in twins if got.get(b) == a} == set(twins)
    exact = [(a, b) for a, b in found if (sig[a] == sig[b]).mean() >= 0.61]
    assert all(got[a] == got[b] for a, b in exact) and len(set(got.values())) >= n / 50 or len(got) == 2 * len(twins)


def test_large_buckets_by_brute_force(spark):
    """One bucket of more than BLOCK nodes in families: the same components as by comparing all pairs, frequent registers and all."""
    rng = np.random.default_rng(2)
    n, width = 2600, 64
    common = rng.integers(0, 1 << 16, width, dtype=np.uint16)
    sig = np.vstack([_signed(rng, np.where(rng.random(width) < 0.5, common, rng.integers(0, 1 << 16, width, dtype=np.uint16)), 0.8, 13, width) for _ in range(n // 13)])
    like = np.array([(sig == s).mean(axis=1) for s in sig])
    parent = np.arange(n)
    for i, j in np.argwhere(np.triu(groups.corrected(like) >= 0.6, 1)):
        a, b = parent[i], parent[j]
        parent[parent == max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(i, sig[i].tobytes(), [7]) for i in range(n)], "node bigint, sig binary, bands array<bigint>")
    got = {r["node"]: r["root"] for r in groups.connected(nodes, nodes, width, 0.6, 0.6).collect()}
    assert [got.get(i, i) for i in range(n)] == parent.tolist()
    assert 50 < len(set(parent.tolist())) < n - 500
    # and by tiles of all members alone
    members = spark.createDataFrame([(i, i, sig[i].tobytes()) for i in range(n)], "node bigint, root bigint, sig binary")
    edges = groups._blocks(groups._tiles(members), width, 0.6, 0.6, False).collect()
    tied = np.arange(n)
    for r in edges:
        a, b = tied[r["a"]], tied[r["b"]]
        tied[tied == max(a, b)] = min(a, b)
    assert tied.tolist() == parent.tolist()


def test_scripts_without_blanks(spark):
    rng = random.Random(10)
    text = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(120))
    near = text[:60] + "字" + text[61:]
    other = "".join(chr(rng.randint(0x0E01, 0x0E2E)) for _ in range(100))
    rows = [(1, text, "zh", "s"), (2, near, "zh", "s"), (3, other, "th", "s"), (4, other[:50] + "ก" + other[51:], "th", "s")]
    got = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_members_matched_to_a_head_still_meet_the_others(spark):
    """Every alike pair of one bucket is connected in a group of copies at 0.4 to 0.9 of their original."""
    rng = random.Random(9)
    base = prose(rng, 150)
    rows = [(0, base, "en", "s")] + [(i, _edited(rng, base, rng.randint(3, 45)), "en", "s") for i in range(1, 1000)]
    docs = table(spark, rows, clash=False)
    got = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicates(docs).collect()}
    bands = {r["doc_id"]: set(r["bands"]) for r in neardup.signatures(docs).collect()}
    sets = [_sorted_shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if find(i) != find(j) and bands[i] & bands[j] and neardup.exact_similarity(*sets[i], *sets[j]) >= neardup.THRESHOLD:
                parent[find(j)] = find(i)
    near = [i for i in range(1, len(rows)) if find(i) == find(0)]
    assert 300 < len(near) < 999
    assert [i for i in near if got[i] != got[0]] == []


def _sorted_shingles(text):
    data, offsets = text_buffers(pa.array([text]))
    _, key, weight, _ = neardup.weighted_shingles(data, offsets)
    return key, weight
