"""Phrases by definition, signatures and groups against exact similarity of phrase sets."""

import random
import re

import numpy as np
import pyarrow as pa

from sondeur.llm import phrases
from sondeur.llm.common import text_buffers
from sondeur.llm.sketch import band_keys, min_hashes

from .conftest import prose, table, word


def _phrases(words):
    seen, out, run = set(), [], ()
    for w in words:
        run = (*run, w)
        if run not in seen:
            seen.add(run)
            out.append(run)
            run = ()
    return out


def test_the_parse_is_lz78():
    words = [random.Random(1).randint(1, 5) for _ in range(300)]
    assert len(phrases.phrase_set(words)) == len(_phrases(words)) == len(set(_phrases(words)))
    assert _phrases("a b a b a".split()) == [("a",), ("b",), ("a", "b")]


def _edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = word(rng)
    return " ".join(words)


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    x, y = np.concatenate([common, a]), np.concatenate([common, b])
    sig = min_hashes(2, np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.06
    few = min_hashes(2, np.array([0, 0, 1, 1]), np.array([1, 2, 1, 2], np.uint64), 256)
    assert (few[0] == few[1]).all() and band_keys(few, 32, 8).shape == (2, 32)


def test_groups_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(40):
        base = prose(rng, rng.randint(40, 300))
        for k in range(rng.choice([1, 2, 3])):
            rows.append((len(rows), base if k == 0 else _edited(rng, base, rng.randint(0, 12)), "en", "s"))
    docs = table(spark, rows)
    # the parse again in plain Python, over words and not their hashes
    sets = [set(_phrases(re.findall(r"[a-z]+", t.lower()))) for _, t, *_ in rows]
    like = np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])
    owner, phrase = phrases.phrase_sets(*text_buffers(pa.array([t for _, t, *_ in rows])))
    assert np.bincount(owner).tolist() == [len(s) for s in sets] and len(phrase) == len(owner)
    got = {r["doc_id"]: r["group_id"] for r in phrases.phrase_groups(docs).collect()}
    # 256 registers tell similarities apart that lie three deviations (0.08) from the threshold
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if like[i, j] >= phrases.THRESHOLD]
    sure = [(i, j) for i, j in pairs if like[i, j] >= phrases.THRESHOLD + 0.08]
    assert len(sure) > 10 and all(got[i] == got[j] for i, j in sure)
    assert sum(got[i] == got[j] for i, j in pairs) / len(pairs) >= 0.9
    for g in set(got.values()):  # each member of a group is like some other
        members = [i for i in got if got[i] == g]
        assert all(len(members) == 1 or max(like[i, j] for j in members if j != i) >= phrases.THRESHOLD - 0.08 for i in members)
    exact = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j]]
    assert all(got[i] == got[j] for i, j in exact)
