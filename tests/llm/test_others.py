"""Mixing, packing, token counts, chat formatting, WARC and licences against brute force and exact round trips."""

import gzip
import hashlib
import json
import os
import random
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sondeur.llm import chat, licences, mixing, packing, tokencount, warc
from sondeur.llm.common import shared_folder, text_buffers
from sondeur.llm.sketch import min_hashes

from .conftest import prose, table, word

# Mixing


def _fill(budget, caps, weights):
    """Water-filling by rounds: what a child can't take goes to its siblings by weight."""
    given = {c: 0.0 for c in caps}
    open_ = {c for c in caps if weights[c] > 0}
    left = min(budget, sum(caps.values()))
    while left > 1e-9 and open_:
        total = sum(weights[c] for c in open_)
        share = {c: left * weights[c] / total for c in open_}
        full = {c for c in open_ if given[c] + share[c] >= caps[c] - 1e-12}
        if not full:
            for c in open_:
                given[c] += share[c]
            return given
        for c in full:
            left -= caps[c] - given[c]
            given[c] = caps[c]
        open_ -= full
    return given


def test_budgets_by_rounds(spark):
    rng = random.Random(1)
    leaves = [(d, g, s, rng.randint(10, 3000)) for d in ("reference", "forum", "web") for g in ("en", "fr", "xx") for s in ("a", "b", "c") if rng.random() < 0.8]
    weights = {"domain": {"reference": 3.0, "forum": 0.5, "web": 5.0}, "lang": {"en": 6.0, "fr": 0.5}, "source": {"a": 2.0}}
    total = sum(x[3] for x in leaves)
    for share in (0.3, 1.0, 1.9, 2.5):
        want, budget = {}, {(): total * share}
        for level in range(3):
            nodes = defaultdict(float)
            for x in leaves:
                nodes[x[: level + 1]] += x[3] * 2
            nxt = {}
            for parent, b in budget.items():
                caps = {k: v for k, v in nodes.items() if k[:level] == parent}
                nxt |= _fill(b, caps, {k: weights[mixing.LEVELS[level]].get(k[-1], 1.0) for k in caps})
            budget = want = nxt
        got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint"), share, 2, weights).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * total for k in want)
        assert abs(sum(got.values()) - min(share, 2) * total) < 1e-6 * total


def test_each_leaf_takes_a_prefix_of_its_epoch(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(5, 60)), rng.choice(["en", "de"]), rng.choice(["src0", "src4", "src12"])) for i in range(400)]
    docs = table(spark, rows)
    got = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs, 1.4, 2).collect()}
    _, cuts = mixing.selection(docs, 1.4, 2)
    for c in cuts.collect():
        own = [(i, len(t.split())) for i, t, g, s in rows if g == c["lang"] and s == c["source"]]
        own.sort(key=lambda x: hashlib.md5(f"{mixing.SEED}:{c['whole'] + 1}:{x[0]}".encode()).hexdigest())
        before = 0
        for i, n in own:
            assert got.get(i, 0) == c["whole"] + (c["rest"] > 0 and before < c["rest"])
            before += n
    again = Counter(r["doc_id"] for r in mixing.mixture(docs, 1.4, 2).collect())
    assert again == Counter(got)


# Packing


def test_a_walk_by_hand():
    e = lambda *pairs: {u: [(a, v) for x, v, a in pairs if x == u] + [(a, x) for x, v, a in pairs if v == u] for u in {p for x, v, _ in pairs for p in (x, v)}}
    # a star with a tail: 4 and 3 have one neighbour each; 3 is least; then 2, its best neighbour 1, then 4 anew
    assert packing.walk(e((1, 2, 0.9), (2, 3, 0.8), (2, 4, 0.7))) == [(1, 0), (2, 0), (3, 0), (4, 1)]


def _pieces(docs, window):
    rows = packing.packed(docs, window).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["window"]].append((r["at"], r["n"]))
    return rows, by


def test_every_token_is_in_one_window(spark, messy):
    rows, by = _pieces(messy, 256)
    for w, parts in by.items():
        parts.sort()
        at = 0
        for a, n in parts:
            assert a == at and n > 0
            at += n
        assert at == 256 or w == max(by)
    assert sorted(by) == list(range(len(by)))
    want = Counter()
    for r in messy.collect():
        want[r["doc_id"]] += len((r["text"] or "").split())
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["n"]
    assert got == Counter({k: v for k, v in want.items() if v})


def test_walks_of_random_graphs_by_definition():
    rng = random.Random(12)
    for _ in range(50):
        n = rng.randint(2, 30)
        edges = defaultdict(list)
        for u in range(n):
            for v in range(u + 1, n):
                if rng.random() < 0.15:
                    alike = rng.randint(1, 4) / 4
                    edges[u].append((alike, v))
                    edges[v].append((alike, u))
        left, want, path = set(edges), [], -1
        while left:
            at, path = min(left, key=lambda u: (len(edges[u]), u)), path + 1
            while at is not None:
                left.remove(at)
                want.append((at, path))
                at = min((v for _, v in edges[at] if v in left), key=lambda v: (-dict((y, x) for x, y in edges[at])[v], len(edges[v]), v), default=None)
        assert packing.walk(dict(edges)) == want


def _runs(text):
    words = text.split()
    return {tuple(words[i : i + packing.SHINGLE]) for i in range(max(1, len(words) - packing.SHINGLE + 1))}


def _graph(spark, rows):
    """(doc_id to its neighbours' doc_ids, sketches by doc_id); all texts differ."""
    made = packing.sketches(table(spark, rows)).collect()
    doc = {r["node"]: r["doc_id"] for r in made}
    nodes = spark.createDataFrame([(r["node"], r["sig"], r["bands"]) for r in made], "node bigint, sig binary, bands array<bigint>")
    graph = defaultdict(set)
    for r in packing.neighbours(nodes, nodes).collect():
        graph[doc[r["u"]]].add(doc[r["v"]])
        graph[doc[r["v"]]].add(doc[r["u"]])
    return graph, {r["doc_id"]: np.frombuffer(bytes(r["sig"]), np.uint16) for r in made}


def test_neighbours_by_exact_similarity(spark):
    """Documents that share passages alone: each one's nearest by exact Jaccard similarity."""
    rng = random.Random(3)
    passages = [[word(rng) for _ in range(rng.randint(50, 80))] for _ in range(60)]
    rows = []
    for i in range(600):
        words = [word(rng) for _ in range(rng.randint(80, 300))]
        for p in rng.sample(passages, rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(words))
            words[at:at] = p
        rows.append((i, " ".join(words), "en", "src1"))
    graph, _ = _graph(spark, rows)
    sets = [_runs(t) for _, t, *_ in rows]
    like = np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])
    np.fill_diagonal(like, -1)
    hit = want = 0
    for u in range(len(rows)):
        if like[u].max() >= 0.05:  # the nearest, or one that is nearly as near
            want += 1
            hit += max((like[u][v] for v in graph[u]), default=0) >= 0.75 * like[u].max()
        elif like[u].max() == 0:
            assert not graph[u]
    assert want > 300 and hit / want >= 0.9


@pytest.mark.parametrize("kind", ["families", "one family", "one passage"])
def test_nearest_neighbours_in_large_buckets(spark, kind):
    rng = random.Random(5)
    shared = [word(rng) for _ in range(150)]
    families = [[word(rng) for _ in range(150)] for _ in range(500)]
    rows = []
    for i in range(2500):
        if kind == "one passage":
            words = [word(rng) for _ in range(60)] + shared
        else:
            words = list(shared if kind == "one family" else (families[i // 5][:60] + shared[60:]))
            for _ in range(rng.randint(2, 8)):
                words[rng.randrange(150)] = word(rng)
        rows.append((i, " ".join(words), "en", "src1"))
    graph, sig = _graph(spark, rows)
    m = np.array([sig[i] for i in range(len(rows))])
    exact = [_runs(t) for _, t, *_ in rows]
    hit = want = 0
    for u in range(0, len(rows), 10):
        like = (m == m[u]).mean(axis=1)
        like[u] = -1
        near = np.sort(like)[::-1][: packing.NEAREST]
        want += len(near)
        # as near by exact similarity as the sketches' nearest, but for their noise
        far = sorted((len(exact[u] & exact[v]) / len(exact[u] | exact[v]) for v in np.argsort(-like)[: packing.NEAREST]), reverse=True)
        own = sorted((len(exact[u] & exact[v]) / len(exact[u] | exact[v]) for v in graph[u]), reverse=True)[: packing.NEAREST]
        hit += sum(x >= 0.85 * y for x, y in zip(own, far, strict=False))
    print(kind, "recall", hit / want, "of", want)
    assert hit / want >= 0.9


@pytest.mark.parametrize("tile", [4096, 700])
def test_nearest_in_large_buckets_are_the_nearest_of_all(spark, monkeypatch, tile):
    """Two large buckets with common nodes, and one apart: no node misses a nearer one than it has."""
    monkeypatch.setattr(packing, "TILE", tile)
    rng = np.random.default_rng(8)
    sig = rng.integers(0, 4, (4500, packing.BINS)).astype(np.uint16)
    keys = [{1} if i < 1000 else {1, 2} if i < 2000 else {2} if i < 3000 else {3} for i in range(4500)]
    nodes = spark.createDataFrame([(i, sig[i].tobytes(), sorted(keys[i])) for i in range(4500)], "node bigint, sig binary, bands array<bigint>")
    got = defaultdict(set)
    for r in packing.neighbours(nodes, nodes).collect():
        got[r["u"]].add(r["v"])
        got[r["v"]].add(r["u"])
    for u in range(0, 4500, 10):
        agree = (sig == sig[u]).sum(axis=1)
        mine = [v for v in range(4500) if v != u and keys[u] & keys[v]]
        want = sorted((int(agree[v]) for v in mine), reverse=True)[: packing.NEAREST]
        own = sorted((int(agree[v]) for v in got[u]), reverse=True)[: packing.NEAREST]
        assert all(x >= y for x, y in zip(own, want, strict=True))


def test_buckets_of_the_same_nodes_are_one(spark):
    """Also among those that a sample shows to be hot; each set of two or more nodes that share a key stays."""
    keys = {i: [1, 2, 3] if i < 4500 else [] for i in range(5000)}
    for a in range(4500, 5000, 5):  # two that share 30 keys, three of them that share 6, and keys of one node
        for k in range(40):
            for i in range(a, a + (2 if k < 30 else 3 if k < 36 else 1)):
                keys[i].append(1000 * a + k)
    nodes = spark.createDataFrame(list(keys.items()), "node bigint, bands array<bigint>")
    got = defaultdict(set)
    rows = packing.member_sets(nodes).collect()
    for r in rows:
        got[r["key"]].add(r["node"])
    want = [set(range(4500))] + [{a, a + 1} for a in range(4500, 5000, 5)] + [{a, a + 1, a + 2} for a in range(4500, 5000, 5)]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert len(rows) == sum(map(len, want)) and all(r["size"] == len(got[r["key"]]) for r in rows)


def test_large_components_are_walked_whole(spark):
    """By definition, along weak edges too: components of 25 000 and of 400 nodes, which end in one path and in many."""
    rng = random.Random(13)
    edges = {(i, i + 1): 0.05 for i in range(24_999)} | {tuple(sorted(rng.sample(range(30_000, 30_400), 2))): rng.randint(1, 5) / 64 for _ in range(1500)}
    edges |= {tuple(sorted((i, rng.randrange(25_000)))): rng.randint(1, 3) / 64 for i in rng.sample(range(25_000), 4000)}
    edges = [(u, v, round(x, 6)) for (u, v), x in edges.items() if u != v]
    near = defaultdict(list)
    for u, v, x in edges:
        near[u].append((x, v))
        near[v].append((x, u))
    want = {}
    for lo, hi in ((0, 25_000), (30_000, 30_400)):
        seen, path = set(), -1
        for start in sorted((u for u in near if lo <= u < hi), key=lambda u: (len(near[u]), u)):
            at, path = (start, path + 1) if start not in seen else (None, path)
            while at is not None:
                seen.add(at)
                want[at] = (lo, path, len(seen) - 1)
                at = min(((-x, len(near[v]), v) for x, v in near[at] if v not in seen), default=(None,))[-1]
    got = {r["node"]: (r["root"], r["path"], r["place"]) for r in packing.paths(spark.createDataFrame(edges, "u bigint, v bigint, alike double")).collect()}
    roots = {lo: min(u for u in near if u >= lo) for lo in (0, 30_000)}
    assert got == {u: (roots[lo], path, place) for u, (lo, path, place) in want.items()}


def test_related_documents_are_packed_together(spark):
    rng = random.Random(4)
    rows, groups = [], {}
    for g in range(30):
        base = [word(rng) for _ in range(80)]
        for _ in range(3):
            words = list(base)
            for _ in range(4):
                words[rng.randrange(len(words))] = word(rng)
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(words), "en", "src1"))
    rng.shuffle(rows)
    order = [r["doc_id"] for r in sorted(packing.packed(table(spark, rows), 500).collect(), key=lambda r: (r["window"], r["at"])) if r["first"] == 0]
    beside = sum(groups[a] == groups[b] for a, b in zip(order, order[1:], strict=False))
    assert beside >= 55  # of 60 places between members of one group


def test_sketch_of_repeated_elements_is_that_of_the_set():
    a = min_hashes(1, np.zeros(6, np.int64), np.array([5, 6, 7, 5, 6, 7], np.uint64), 64)
    assert (a == min_hashes(1, np.zeros(3, np.int64), np.array([7, 6, 5], np.uint64), 64)).all()


# Token counts


@pytest.mark.parametrize("file", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_equal_one_by_one(spark, messy, file):
    """Every row, null ids and the very long texts included."""
    t = tokencount.Tokenizer(f"{tokencount.FOLDER}/{file}")
    rows = messy.select("doc_id", "text").collect()
    want = Counter(zip((r["doc_id"] for r in rows), tokencount.brute_force([r["text"] for r in rows], t).tolist(), strict=True))
    assert max(n for _, n in want) > 50_000
    assert Counter((r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(messy, None, t).collect()) == want


def test_each_distinct_text_is_encoded_once_and_in_place(spark, messy):
    t = tokencount.Tokenizer().loaded()
    known = tokencount.digests(messy).persist()
    wanted = known.groupBy("digest").agg({"at": "count"}).count()
    one = known.selectExpr("digest", "struct(part, at) AS p").groupBy("digest").agg({"p": "min"}).selectExpr("digest", "`min(p)`.part", "`min(p)`.at")
    made = tokencount.in_place(messy, one, t).collect()
    assert len(made) == len({bytes(r["digest"]) for r in made}) == wanted
    # rows that stand elsewhere in a second reading are gathered by digest
    shifted = one.selectExpr("digest", "part", "at + 1 AS at")
    assert tokencount.in_place(messy, shifted, t).count() < wanted
    cache, real = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}", tokencount.in_place
    tokencount.in_place = lambda docs, chosen, tokenizer: real(docs, shifted, tokenizer)
    try:
        got = Counter((r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(messy, cache, t).collect())
    finally:
        tokencount.in_place = real
    assert got == Counter((r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(messy, None, t).collect())
    rows = spark.read.parquet(f"{cache}/{t.version}")
    assert rows.count() == rows.select("digest").distinct().count() == wanted
    known.unpersist()


def test_the_cache_is_read_and_only_misses_are_added(spark, messy):
    cache = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    t = tokencount.Tokenizer()
    some = messy.where("doc_id < 120")
    tokencount.token_counts(some, cache, t).count()
    first = spark.read.parquet(f"{cache}/{t.version}").count()
    assert first == some.select("text").fillna("").distinct().count()
    # a forged count proves that it is read and not worked out again
    forged = tokencount.digests(messy.where("doc_id = 130")).select("digest").selectExpr("digest", "CAST(123456 AS BIGINT) AS n_tokens")
    forged.write.mode("append").parquet(f"{cache}/{t.version}")
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(messy, cache, t).collect()}
    assert got[130] == 123456
    rows = spark.read.parquet(f"{cache}/{t.version}")
    assert rows.count() == rows.select("digest").distinct().count() == messy.select("text").fillna("").distinct().count()
    assert tokencount.Tokenizer(f"{tokencount.FOLDER}/byte_bpe_50k.json").version != t.version


def test_normal_forms_share_a_digest():
    assert tokencount.normalised("é\r\nx\ry") == "é\nx\ny" and tokencount.normalised(None) == ""


# Chat formatting

LAYOUTS = [
    ({"messages": [{"role": "User", "content": "a", "weight": 1}, {"role": "assistant", "content": "b"}], "id": 4}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"system": "s", "messages": [{"role": "user", "content": "a"}]}, "messages", [("system", "s"), ("user", "a")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}, "sharegpt", [("user", "a"), ("assistant", None)]),
    ({"dialog": [{"speaker": "bot", "text": "a"}]}, "dialog", [("assistant", "a")]),
    ({"conversation": {"messages": [{"author": "human", "content": {"text": "a"}}]}, "meta": {"x": [1, {"y": 2}]}}, "nested-messages", [("user", "a")]),
    ({"instruction": "do", "input": "", "output": "x"}, "alpaca", [("user", "do"), ("assistant", "x")]),
    ({"instruction": "do", "input": "it", "output": "x"}, "alpaca", [("user", "do\n\nit"), ("assistant", "x")]),
    ({"prompt": "p", "completion": "c", "turn": None}, "prompt-completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": 5}, "prompt-response", [("user", "p"), ("assistant", "5")]),
    ({"context": "c", "question": "q", "answer": "a"}, "question-answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"turn": 3, "role": "USER", "text": "hi", "conv_id": 1}, "turn-row", [("user", "hi")]),
    ({"conversations": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "role-conversations", [("user", "a"), ("assistant", "b")]),
    ({"instruction": "do", "context": "with", "response": "x"}, "instruction-response", [("user", "do\n\nwith"), ("assistant", "x")]),
    ({"prompt": "p", "chosen": "c", "rejected": "r"}, "preference", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p"}, "prompt-alone", [("user", "p")]),
    # known paths of other layouts beside: the most specific one that fits counts
    ({"turn": 3, "role": "user", "text": "hi", "system": "s", "input": 1}, "turn-row", [("user", "hi")]),
    ({"prompt": "p", "messages": [{"role": "user", "content": "a"}], "text": "t"}, "messages", [("user", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "see"}, {"type": "image", "url": "u"}, "this"]}]}, "messages", [("user", 'see\n{"type": "image", "url": "u"}\nthis')]),
    ({"instruction": "do", "output": "x", "text": "all", "history": []}, "alpaca", [("user", "do"), ("assistant", "x")]),
    ({"messages": [{"role": "user", "content": "w " * 300_000}]}, "messages", [("user", "w " * 300_000)]),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(LAYOUTS)]
    bad = [(100, None), (101, "{"), (102, "[1]"), (103, '{"messages": []}'), (104, '{"foo": 1}'), (105, "[" * 5000), (None, '{"prompt": "p", "completion": "c"}')]
    docs = spark.createDataFrame([(i, r, "x", 1) for i, r in [*rows, *bad, rows[0]]], "record_id bigint, record string, turn string, role int")
    got = defaultdict(list)
    for r in chat.canonical_turns(docs, "record_id").collect():
        got[r["record_id"]].append((r["turn"], r["role"], r["content"], r["layout"]))
    for i, (_, layout, want) in enumerate(LAYOUTS):
        first = 3 if layout == "turn-row" else 0
        expected = [(first + k, role, content, layout) for k, (role, content) in enumerate(want)]
        assert sorted(got[i]) == sorted(expected * (2 if i == 0 else 1))
    assert all(got[i] == [(None, None, None, None)] for i in range(100, 106))
    assert len(got[None]) == 2
    assert chat.canonical_turns(docs.limit(0), "record_id").count() == 0


def test_fingerprints_know_structure_alone():
    a, b = ({"messages": [{"role": "x", "content": c}]} for c in ("1", 2))
    assert chat.fingerprint(chat.field_paths(a)) == chat.fingerprint(chat.field_paths(b)) != chat.fingerprint(chat.field_paths({"messages": [{"role": "x"}]}))


def test_table_rows(spark):
    rows = spark.createDataFrame([(1, 0, "Human", "a", "k"), (1, 1, None, "b", "k"), (1, None, "user", "c", "k"), (None, 5, "user", None, "k"), (1, 0, "Human", "a", "k")], "conv_id bigint, turn bigint, role string, text string, layout string")
    got = Counter(tuple(r)[:4] for r in chat.table_turns(rows).collect())
    assert got == Counter([(1, 0, "user", "a"), (1, 1, None, "b"), (1, None, None, None), (None, 5, "user", None), (1, 0, "user", "a")])


def test_table_rows_keep_their_turns_beside_any_column(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    want = Counter(tuple(r)[:5] for r in chat.table_turns(rows).collect())
    assert all(r[1] is not None and r[4] == "turn-row" for r in want)
    for name in ("system", "input", "prompt", "instruction", "output", "completion", "content"):
        assert Counter(tuple(r)[:5] for r in chat.table_turns(rows.selectExpr("*", f"'x' AS {name}")).collect()) == want
    many = rows.selectExpr("*", "'x' AS prompt", "'y' AS completion", "'z' AS instruction", "1 AS output")
    assert Counter(tuple(r)[:5] for r in chat.table_turns(many).collect()) == want
    nothing = rows.limit(0).selectExpr("*", "'x' AS system")
    assert chat.table_turns(nothing).count() == 0


def test_sql_of_rows_without_turns(spark):
    import duckdb

    data = [(1, 0, "Human", "a"), (1, 1, None, "b"), (1, None, "user", "c"), (None, 5, "user", None), (2, None, None, None), (2, None, None, "x"), (3, 0, "odd Role", "")]
    own = Counter(tuple(r) for r in chat.table_turns(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    assert own == Counter(con.execute(chat.oracle()).fetchall())


# WARC


def _records(data):
    """(headers, block) of the records of a file, member by member."""
    out, text = [], gzip.decompress(data)
    while text:
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        named = dict(x.split(": ", 1) for x in lines[1:])
        n = int(named["Content-Length"])
        out.append((named, rest[:n]))
        assert rest[n : n + 4] == b"\r\n\r\n"
        text = rest[n + 4 :]
    return out


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(5)
    pages = [(i, f"http://h{rng.randint(0, 9)}.org/{i}", "<p>" + prose(rng, rng.randint(0, 300)) + "</p>") for i in range(120)]
    pages += [(200, None, "x"), (201, "", None), (None, "http://n.org/", "y"), (203, "http://a b.org/\n", "<p>"), (7, *pages[7][1:]), (204, "http://big.org/", "".join(chr(rng.randint(33, 1000)) for _ in range(40_000)))]
    df = spark.createDataFrame([(i, u, h, "f", 3) for i, u, h in pages], "page_id bigint, url string, html string, file string, size int")
    digests = []
    for k, parts in enumerate((1, 5)):
        folder = f"{tmp_path}/out{k}"
        index = warc.write_warc(df.repartition(parts), folder, roll=8_000).collect()
        names = sorted({r["file"] for r in index})
        listed = json.loads((tmp_path / f"out{k}/manifest.json").read_text())
        assert sorted(p.name for p in (tmp_path / f"out{k}").iterdir() if not p.name.endswith(".crc")) == sorted([*names, "manifest.json"])
        assert [x["file"] for x in listed] == names and len({n[10:18] for n in names}) == len(names) > 3
        seen, order = Counter(), []
        for x in listed:
            data = (tmp_path / f"out{k}" / x["file"]).read_bytes()
            assert len(data) == x["bytes"] and hashlib.sha256(data).hexdigest() == x["sha256"]
            info, *found = _records(data)
            assert info[0]["WARC-Type"] == "warcinfo" and len(found) == x["records"]
            for named, block in found:
                http, _, payload = block.partition(b"\r\n\r\n")
                assert named["WARC-Payload-Digest"] == warc._sha1(payload) and named["WARC-Block-Digest"] == warc._sha1(block)
                assert f"Content-Length: {len(payload)}".encode() in http
                seen[named["WARC-Target-URI"], payload.decode()] += 1
                order.append(named["WARC-Target-URI"])
            own = [r for r in index if r["file"] == x["file"]]
            for r in own:  # each member can be read by itself
                (named, _), = _records(data[r["offset"] : r["offset"] + r["length"]])
                assert named["WARC-Target-URI"] == r["url"]
        assert order == sorted(order)
        assert seen == Counter((warc.target(u, "null" if i is None else str(i)), h or "") for i, u, h in pages)
        assert Counter(r["page_id"] for r in index) == Counter(i for i, _, _ in pages)
        digests.append([x["sha256"] for x in listed])
    assert digests[0] == digests[1]  # the same bytes however the pages are partitioned


def test_files_do_not_depend_on_the_number_of_tasks(spark):
    """The first records of runs of files, by walking all records in order."""
    pages = [(i % 90, f"http://h{i % 7}.org/{i % 90}", "x" * (i % 13) * 50 + str(i % 90)) for i in range(300)]  # with equal rows
    made = warc.records(spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3))
    rows = sorted((bytes(r["key"]), r["size"]) for r in made.select("key", "size").collect())
    at, seen = 0, {}
    for key, size in rows:
        seen.setdefault(key, at)
        at += size
    for roll, tasks in ((2_000, 4096), (2_000, 3), (500, 7), (10**9, 5)):
        each = roll * max(1, -(-at // (roll * tasks)))
        want = {}
        for key, start in sorted(seen.items()):
            want.setdefault(start // each, (key, start))
        assert warc.first_keys(made, roll, tasks) == [want[k] for k in sorted(want)]
        assert len(want) <= tasks + 1


def test_warc_again_into_one_folder(spark, tmp_path):
    """A second run replaces the first; until its manifest is there the first one's files are, and other files stay."""
    df = spark.createDataFrame([(i, f"http://a.org/{i}", "text " * i) for i in range(50)], "page_id bigint, url string, html string")
    folder = tmp_path / "out"
    warc.write_warc(df, str(folder), roll=1_000)
    (folder / "notes.txt").write_text("mine")
    (folder / ".warc-writing-part-left").write_text("of a task that died")
    first = {x["file"] for x in json.loads((folder / "manifest.json").read_text())}
    made = []
    commit = warc.commit
    warc.commit = lambda *a: (made.append({p.name for p in folder.iterdir()}), commit(*a))
    try:
        warc.write_warc(df.where("page_id < 40").withColumn("html", df["html"]), str(folder), roll=1_000)
    finally:
        warc.commit = commit
    assert first <= made[0]
    second = {x["file"] for x in json.loads((folder / "manifest.json").read_text())}
    assert {p.name for p in folder.iterdir() if not p.name.endswith(".crc")} == second | {"manifest.json", "notes.txt"}
    warc.write_warc(df, str(folder), roll=1_000)
    assert {x["file"] for x in json.loads((folder / "manifest.json").read_text())} == first


def test_warc_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.write_warc(df, f"{tmp_path}/none").count() == 0
    assert json.loads((tmp_path / "none/manifest.json").read_text()) == []


# Licences


def test_licences_in_other_dress(spark):
    mit = licences.KNOWN["MIT"]
    wrapped = "/*\n" + "\n".join(" * " + " ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9)) + "\n */"
    british = licences.KNOWN["Zlib"].replace("acknowledgment", "acknowledgement")
    rows = [
        (1, mit, "MIT"), (2, mit.upper(), "MIT"), (3, "MIT License\n\nCopyright (c) 2020 Someone Else\nAll rights reserved.\n\n" + wrapped, "MIT"), (4, wrapped, "MIT"), (5, british, "Zlib"), (6, mit + " Not really.", None),
        (7, None, None), (8, "", None), (9, "Copyright 1999 X", None), (10, "released under the mit licence!", "MIT"), (11, licences.KNOWN["BSD-3-Clause"].replace("\n", "\r\n"), "BSD-3-Clause"), (None, licences.KNOWN["ISC"], "ISC"),
        (12, "© 2020 Me\n" + licences.KNOWN["Unlicense"], "Unlicense"), (13, "some prose\n\n" + mit, None), (14, "(c) 1999-2004 X\n" + mit, "MIT"), (15, "Copyright (c) <year> <holders>\n" + mit, "MIT"),
    ]
    got = {r["doc_id"]: r["licence"] for r in licences.licence_scan(table(spark, [(i, t, "en", "s") for i, t, _ in rows])).collect()}
    assert got == {i: want for i, _, want in rows}


def test_clauses_that_begin_with_c_stay(spark):
    """A clause "(c) You must ..." counts, however its text is wrapped; a copyright line doesn't."""
    clause = "(a) You must keep this. (b) You must give notice. (c) You must cause the files to carry notices. (d) All that."
    texts = [clause, clause.replace(" (", "\n("), clause.replace("(c) ", "\n  (c) "), clause.replace("(c) ", "(c)\n"), "(c) 2001 Somebody\n" + clause, clause.replace("(c) You must cause the files to carry notices. ", "")]
    got = {r["doc_id"]: r["digest"] for r in licences.licence_scan(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert len({got[i] for i in range(5)}) == 1 and got[5] != got[0]


def test_digests_of_published_texts(spark):
    """Long licences, where this machine has their texts: as published, wrapped anew, and in other case."""
    folder, files = "/usr/share/common-licenses", {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = {n: f"{folder}/{f}" for f, n in files.items() if os.path.exists(f"{folder}/{f}")}
    if not found:
        pytest.skip("no licence texts here")
    rows, want = [], {}
    for name, path in found.items():
        with open(path) as f:
            text = f.read()
        for form in (text, text.upper(), text.replace("\n", "\r\n"), "\n".join(" * " + x for x in text.split("\n")), text + "\nmore", text[: len(text) // 2]):
            want[len(rows)] = name if len(rows) % 6 < 4 else None
            rows.append((len(rows), form, "en", "s"))
    assert {r["doc_id"]: r["licence"] for r in licences.licence_scan(table(spark, rows)).collect()} == want


def test_a_text_buffer_of_a_slice():
    data, offsets = text_buffers(pa.array(["ab", None, "c"]).slice(1))
    assert offsets[-1] - offsets[0] == 1 and bytes(data[offsets[0] : offsets[-1]]) == b"c"
