"""Every registered query against its SQL, and the registry without its optional parts."""

import os
import re
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from sondeur.queries import ORACLE, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def _plain(row):
    return tuple(round(x, 5) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    own = QUERIES[name](spark, sf)
    if name not in ORACLE:
        assert own.count() > 0
        return
    there = con.execute(ORACLE[name])
    columns = [d[0] for d in there.description]
    assert sorted(columns) == sorted(own.columns)
    assert Counter(_plain(r) for r in own.select(*columns).collect()) == Counter(_plain(r) for r in there.fetchall())


def test_proximity_ranks_by_windows(spark, sf):
    """Scores with proximity over those without, held against positions worked out in Python."""
    from sondeur.config import SearchOptions
    from sondeur.operators.proximity import plain_factor
    from sondeur.operators.search import search
    from sondeur.queries import document_index

    index = document_index(spark, sf)
    words = ["of", "the", "and"]
    near, far = ({r["doc_id"]: r["score"] for r in search(index, "of the and ", SearchOptions(max_suffix=0, proximity=p)).matches.collect()} for p in (True, False))
    places = {}
    for r in index.scan(words).select("term", "doc_id", "pos_0").collect():
        places.setdefault(r["doc_id"], {})[r["term"]] = list(r["pos_0"])
    assert near.keys() == far.keys() == places.keys()
    for d, own in places.items():
        lists = [own[w] for w in words if w in own]
        assert abs(near[d] - far[d] * (plain_factor(lists, 3, 2) if len(lists) >= 2 else 1.0)) < 1e-9


def test_without_the_corpus_operators(tmp_path):
    """The registry imports and answers when that subpackage, its tests and the pipeline are gone."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_or' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]


def test_nothing_else_imports_them():
    for folder, _, files in os.walk(os.path.join(ROOT, "sondeur")):
        if "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, f)).read()), f
