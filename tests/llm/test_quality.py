"""The classifier and the rules: trees by definition, held-out accuracy, clean documents kept."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sondeur.llm import quality
from sondeur.llm.textstats import statistics
from sondeur.llm.trees import FlatTrees, calibrated, fit_boosted, fit_isolation

from .conftest import prose, table


def _walk(trees: FlatTrees, row):
    total = trees.base
    inner = trees.feature.shape[1]
    for t in range(len(trees.leaf)):
        node = 0
        while node < inner:
            node = 2 * node + 1 + (row[trees.feature[t, node]] > trees.threshold[t, node])
        total += trees.leaf[t, node - inner]
    return total


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = fit_boosted(x, y, trees=20)
    assert np.allclose(trees.total(x), [_walk(trees, r) for r in x])
    held = rng.normal(size=(500, 5))
    assert ((trees.total(held) > 0) == ((held[:, 0] > 0) ^ (held[:, 1] > 0.5))).mean() > 0.9


def _expected(n):
    return 2 * (sum(1 / k for k in range(1, n)) if n < 3 else np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 1 else 0.0


def _plain_forest(x, trees, sample, depth, seed):
    """Nested tuples (feature, cut, left, right) or (rows,), grown from the same draws."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        root = []
        stack = [(root, 0, x[rng.choice(len(x), sample, replace=False)])]
        while stack:
            at, level, part = stack.pop()
            wide = [f for f in range(x.shape[1]) if len(part) and part[:, f].max() > part[:, f].min()]
            if level == depth or len(part) < 2 or not wide:
                at.append(len(part))
                continue
            f = rng.choice(np.array(wide))
            cut = part[:, f].min() + rng.random() * (part[:, f].max() - part[:, f].min())
            left, right = [], []
            at += [f, cut, left, right]
            stack += [(left, level + 1, part[part[:, f] <= cut]), (right, level + 1, part[part[:, f] > cut])]
        out.append(root)
    return out


def _plain_path(tree, row):
    level = 0
    while len(tree) > 1:
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
        level += 1
    return level + _expected(tree[0])


def test_isolation_paths_equal_a_plain_walk():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 4)), 1)  # with ties
    x[:, 3] = 1.0  # a constant feature is never drawn
    forest = fit_isolation(x, trees=25, sample=64, depth=6, seed=9)
    plain = _plain_forest(x, 25, 64, 6, 9)
    rows = np.vstack([x[:60], rng.normal(4, 2, size=(20, 4))])
    want = [2 ** (-np.mean([_plain_path(t, r) for t in plain]) / _expected(64)) for r in rows]
    assert np.allclose(forest.score(rows), want)


def test_isolation_scores_outliers_higher():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(500, 4)), rng.normal(8, 1, size=(5, 4))])
    score = fit_isolation(x).score(x)
    assert score[-5:].min() > np.quantile(score[:-5], 0.98)


def test_threshold_spares_good_rows():
    score, bad = np.array([0.1, 0.2, 0.3, 0.9, 0.8, 0.25]), np.array([0, 0, 0, 1, 1, 0])
    assert 0.3 < calibrated(score, bad, 0.0) < 0.8
    assert calibrated(score, np.zeros(6), 0.0) == float("inf")


def _junk(rng, words):
    kind = rng.randint(0, 2)
    if kind == 0:
        return " ".join("BUY!! NOW!! " + rng.choice(["$$$", "###", "%%%"]) for _ in range(words))
    if kind == 1:
        return "\n".join(["click here"] * words)
    return "".join(rng.choice("0123456789#$%&@ ") for _ in range(6 * words))


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(1800):
        bad = i % 5 == 0
        rows.append((i, _junk(rng, rng.randint(30, 80)) if bad else prose(rng, rng.randint(30, 300)), "en", "s"))
        if i < 1200:
            marks.append((i, int(not bad), 0))
    return table(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("run", [quality.quality_classifier, quality.quality_rules])
def test_held_out_documents(run, judged):
    docs, labels = judged
    keep = {r["doc_id"]: r["keep"] for r in run(docs, labels).collect() if r["doc_id"] >= 1200}
    bad = [k for i, k in keep.items() if i % 5 == 0]
    good = [k for i, k in keep.items() if i % 5]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.2


def test_the_bound_on_labelled_rows_counts_rows(spark, judged):
    docs, labels = judged
    many = docs.unionByName(docs.where("doc_id < 5").crossJoin(spark.range(200).withColumnRenamed("id", "again")).drop("again"))
    more = labels.unionByName(spark.createDataFrame([(10_000 + i, 1, 0) for i in range(3000)], labels.schema))
    rows = quality.labelled(many, more)
    assert rows.count() == rows.select("id").distinct().count() == 1200
    x, good = quality.sample(rows, 50)
    assert len(x) == len(good) == 50


def test_ids_of_any_type(judged):
    docs, labels = judged
    want = {str(r["doc_id"]): r["keep"] for r in quality.quality_rules(docs, labels).collect()}
    for kind in ("int", "string"):
        own = docs.withColumn("doc_id", docs["doc_id"].cast(kind))
        for run in (quality.quality_rules, quality.quality_classifier):
            got = {str(r["doc_id"]): r["keep"] for r in run(own, labels).collect()}
            assert got.keys() == want.keys()
        assert quality.only_good(own, own, labels).dtypes == own.dtypes


def test_rules_by_brute_force(judged):
    """The whole operator again, in numpy: percentiles of all good labelled rows, a plain walk, all cuts tried."""
    grid = lambda v: np.expm1(np.rint(np.log1p(v) * quality.STEPS) / quality.STEPS)
    docs, labels = judged
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    ids = sorted(text)
    x = statistics(pa.array([text[i] for i in ids]))
    good = np.array([marks.get(i, -1) for i in ids])
    words = np.expm1(x[:, [1]])
    usual = np.percentile(grid(x[good == 1]), 50, axis=0, method="lower")
    rate = ((x * words + usual * 10) / (words + 10))[:, quality.RULES]
    low, high = np.percentile(grid(rate[good == 1]), [0.2, 99.8], axis=0, method="lower")
    unit = np.maximum(grid(rate[good == 1]).std(axis=0), 1e-3)
    far = np.log1p(np.maximum(np.maximum(low - rate, rate - high), 0) / unit)
    pool, _ = quality.sample(quality.labelled(docs, labels), quality.MAX_LABELLED)
    place = {tuple(r): i for i, r in enumerate(np.round(x, 9))}
    forest = _plain_forest(far[[place[tuple(r)] for r in np.round(pool, 9)]], 200, 256, 8, 7)
    score = np.array([2 ** (-np.mean([_plain_path(t, r) for t in forest]) / _expected(256)) for r in far])
    cuts = [(caught - lost, -c) for c in np.unique(score) if (lost := (score[good == 1] > c).mean()) <= quality.SPARE and (caught := (score[good == 0] > c).mean()) is not None]
    cut = -max(cuts)[1]
    got = {r["doc_id"]: (r["anomaly"], r["keep"]) for r in quality.quality_rules(docs, labels).collect()}
    assert np.mean([abs(got[i][0] - s) < 0.01 for i, s in zip(ids, score, strict=True)]) > 0.98
    assert np.mean([got[i][1] == (s <= cut) for i, s in zip(ids, score, strict=True)]) > 0.99


def test_quantiles_of_all_rows(judged):
    rows = quality.labelled(*judged)
    x = np.array([r["x"] for r in rows.where("good = 1").collect()])
    got, deviation = quality.spread(rows.where("good = 1"), lambda v: v, (0.002, 0.5, 0.998))
    assert np.allclose(got, np.percentile(x, [0.2, 50, 99.8], axis=0, method="lower"), rtol=1e-3, atol=1e-3)
    assert np.allclose(deviation, x.std(axis=0), rtol=1e-3, atol=1e-3)
