"""The pipeline's stages, each over what its predecessor kept, against brute-force versions in plain Python."""

import hashlib
import os
import subprocess
import sys
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from sondeur.llm import mixing, neardup, packing, quality
from sondeur.llm.textstats import NAMES, statistics
from sondeur.llm.trees import fit_boosted

from .test_neardup import _brute_groups
from .test_others import _fill
from .test_quality import _walk


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows before the first stage and after each one, written and read as in production."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf).write.parquet(at)
        docs = spark.read.parquet(at)
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_columns_are_kept(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near-duplicate removal", "source mixing", "packing"]
    assert all(s.dtypes == stages[0].dtypes for s in stages[:-1])
    counts = [s.count() for s in stages[:4]]
    assert counts[0] > counts[1] >= counts[2] > counts[3] > 0


def test_quality_stages_judge_each_text_alone(spark, sf, stages):
    docs, labels = stages[0], spark.read.parquet(f"{sf}/labels.parquet")
    for before, after, fit in ((0, 1, quality.classifier), (1, 2, quality.rules)):
        scorer = fit(docs, labels)
        want = Counter(r for r in rows(stages[before]) if scorer(pa.array([r[1]], pa.string()))[1][0])
        assert Counter(rows(stages[after])) == want
    x, good = quality.sample(quality.labelled(docs, labels), quality.MAX_LABELLED)
    assert x.shape == (len(good), len(NAMES))
    model = fit_boosted(x, good)
    for r in rows(docs)[:40]:  # the flattened trees, node by node
        own = statistics(pa.array([r[1]], pa.string()))
        assert abs(model.total(own)[0] - _walk(model, own[0])) < 1e-9


def test_one_of_each_group_stays(stages):
    before = rows(stages[2])
    groups, _ = _brute_groups(before)
    kept = {r[0] for r in rows(stages[3])}
    assert kept == {i for i, g in groups.items() if i == g}
    assert neardup.THRESHOLD == 0.5


def test_mixing(stages):
    before, after = rows(stages[3]), Counter(r[0] for r in rows(stages[4]))
    member = {s: d for d, ss in mixing.DOMAINS.items() for s in ss}
    leaf = lambda r: (member.get(r[3], mixing.REST), r[2], r[3])
    size = {r: len((r[1] or "").split()) for r in before}
    tokens = defaultdict(int)
    for r in before:
        tokens[leaf(r)] += size[r]
    budget = {(): sum(tokens.values()) * mixing.BUDGET}
    for level, name in enumerate(mixing.LEVELS):
        caps = defaultdict(float)
        for k, n in tokens.items():
            caps[k[: level + 1]] += n * mixing.EPOCHS
        below = {}
        for parent, b in budget.items():
            own = {k: c for k, c in caps.items() if k[:level] == parent}
            below |= _fill(b, own, {k: mixing.WEIGHTS[name].get(k[-1], 1.0) for k in own})
        budget = below
    for k, b in budget.items():
        whole = int(b / tokens[k] + 1e-6)
        rest, seen = round(b - whole * tokens[k], 3), 0
        for r in sorted((r for r in before if leaf(r) == k and size[r]), key=lambda r: hashlib.md5(f"{mixing.SEED}:{whole + 1}:{r[0]}".encode()).hexdigest()):
            assert after[r[0]] == whole + (seen < rest)
            seen += size[r]


def test_packing(stages):
    want = Counter()
    for r in rows(stages[4]):
        want[r[0]] += len(r[1].split())
    got, windows, spans = Counter(), defaultdict(list), defaultdict(list)
    for r in stages[5].collect():
        got[r["doc_id"]] += r["n"]
        windows[r["window"]].append((r["at"], r["n"]))
        spans[r["doc_id"]].append((r["first"], r["n"]))
    assert got == want
    for w, parts in windows.items():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) == packing.WINDOW or w == max(windows)
    assert sorted(windows) == list(range(len(windows)))


def test_run_is_the_chain(spark, sf, stages):
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == Counter(tuple(r) for r in stages[-1].collect())


def _folder(path, docs, labels):
    docs.coalesce(1).write.parquet(f"{path}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_hard_cases_through_the_chain(spark, messy, labels, tmp_path, kind):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns, and ids that are no numbers."""
    sf = _folder(tmp_path / "in", messy.withColumn("doc_id", messy["doc_id"].cast(kind)), labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, kinds = docs, docs.dtypes
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf)
        after.write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert after.dtypes == kinds
            assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}
            before = after
    assert all(r["text"] and r["text"].split() for r in before.collect())
    want = Counter()
    for r in before.collect():
        want[r["doc_id"]] += len(r["text"].split())
    got = Counter()
    for r in after.collect():
        got[r["doc_id"]] += r["n"]
    assert got == want and sum(want.values()) > 0


def test_empty_tables_through_the_chain(spark, messy, nothing, labels, tmp_path):
    assert corpus_pipeline.run(spark, _folder(tmp_path / "none", nothing, labels)).count() == 0
    assert corpus_pipeline.run(spark, _folder(tmp_path / "nor", nothing, labels.limit(0))).count() == 0
    sf = _folder(tmp_path / "unlabelled", messy, labels.limit(0))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.STAGES[0][1](spark, docs, sf), sf)
    assert Counter(r["text"] for r in left.collect()) == Counter(r["text"] for r in docs.collect() if r["text"] and r["text"].split())


def test_batches_of_long_texts_fit_a_small_heap(tmp_path):
    """Over 1000 texts of 250 KB in one row group, read where a batch of 4096 rows doesn't fit."""
    n, body = 1100, "lemon per quiras, solin turven the wolyar. " * 6000
    docs = pa.table({"doc_id": range(n), "text": [f"{i} {body[: 250_000]}" for i in range(n)], "lang": ["en"] * n, "source": ["src1"] * n})
    pq.write_table(docs, f"{tmp_path}/documents.parquet", use_dictionary=False, compression="zstd")
    pq.write_table(pa.table({"doc_id": [0, 1, 2, 3], "quality": [1, 1, 0, 1]}), f"{tmp_path}/labels.parquet")
    code = f"""
import corpus_pipeline
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
docs = spark.read.parquet("{tmp_path}/documents.parquet")
corpus_pipeline.STAGES[1][1](spark, docs, "{tmp_path}").write.parquet("{tmp_path}/out")
"""
    root = os.path.dirname(corpus_pipeline.__file__)
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 720m pyspark-shell", "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-6000:]
    # all texts are alike but for a number, so the good ones among the labelled are no outliers
    assert pq.read_table(f"{tmp_path}/out").num_rows == n
