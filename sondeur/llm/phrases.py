"""Document fingerprints of Lempel-Ziv phrases: texts that one dictionary would compress alike fall together.

A text is read as words of letters and digits in lower case and parsed as by LZ78: each phrase is the shortest run of
words that is not yet in the text's dictionary.  The phrase set is hashed and kept as BINS one-permutation minima.
Two documents are alike if the share of equal minima, an estimate of their phrase sets' Jaccard similarity, is at
least THRESHOLD.  Candidates share one of BANDS keys of ROWS minima (recall 0.98 at the threshold, more above); all of them
that aren't connected yet are compared (see `groups`).  Groups are the connected components of alike pairs.

Defined results: every row gives one row.  A text without words (null, empty or marks only) has no phrases, a null
fingerprint and a null group.  A null doc_id is a row like any other; it names a group only if the group has no other.
Repeated rows and equal phrase sets share a fingerprint and a group.  Columns beside doc_id and text don't matter.  In
scripts without spaces between words (Han, Kana, Thai) each character is a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MARKS, Words, chunks, drop, mix64, stored, text_buffers
from .groups import connected, low_words
from .sketch import band_keys, lists, min_hashes

BINS = 256
BANDS, ROWS = 20, 6
#: The similarity of phrase sets from which two documents are alike.
THRESHOLD = 0.75
_MASK = (1 << 64) - 1


def phrase_set(words: list[int]) -> set[int]:
    """The phrases of the LZ78 parse of a sequence of hashed words, each as a 64-bit hash of its words."""
    seen: set[int] = set()
    add = seen.add
    phrase = 0
    for w in words:
        phrase = (phrase * 0x9E3779B97F4A7C15 + w) & _MASK
        if phrase not in seen:
            add(phrase)
            phrase = 0
    return seen


def phrase_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, phrase) of all phrases of a run of texts."""
    w = Words(data, offsets, MARKS, alone=True)
    words, ends = w.hash.tolist(), np.cumsum(w.count)
    sets = [phrase_set(words[e - c : e]) for c, e in zip(w.count.tolist(), ends.tolist(), strict=True)]
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate([np.fromiter(s, np.uint64, len(s)) for s in sets]) if sets else np.zeros(0, np.uint64)
    return np.repeat(np.arange(len(sets)), sizes), values


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, phrases, node, sig, bands) of every row: node is the digest of the phrase set, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                n = j - i
                owner, phrase = phrase_sets(data, offsets[i : j + 1])
                size = np.bincount(owner, minlength=n)
                digest = np.zeros(n, np.uint64)
                np.add.at(digest, owner, mix64(phrase))
                digest = mix64(digest ^ size.astype(np.uint64))
                sig = min_hashes(n, owner, phrase, BINS)
                blank = pa.array(size == 0)
                null = pa.nulls(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n),
                        pa.array(size),
                        pa.array(digest.view(np.int64), mask=size == 0),
                        pc.if_else(blank, null.cast(pa.binary())[0], low_words(sig)),
                        pc.if_else(blank, null.cast(pa.list_(pa.int64()))[0], lists(band_keys(sig, BANDS, ROWS))),
                    ],
                    ["doc_id", "phrases", "node", "sig", "bands"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, phrases bigint, node bigint, sig binary, bands array<bigint>")


def phrase_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, phrases, fingerprint, group_id, size): group_id is the least doc_id of the alike documents, size their number of rows."""
    rows = stored(fingerprints(docs), "fingerprints")
    nodes = stored(
        rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.first("bands").alias("bands")), "nodes"
    )
    roots = connected(nodes, rows.where("node IS NOT NULL"), BINS, THRESHOLD, THRESHOLD)
    of = nodes.select("node", "id", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = of.groupBy("root").agg(F.min("id").alias("group_id"), F.sum("n").alias("size"))
    by_node = of.select("node", "root").join(groups, "root").drop("root")
    out = stored(rows.select("doc_id", "phrases", "node").join(by_node, "node", "left").select("doc_id", "phrases", F.lower(F.hex("node")).alias("fingerprint"), "group_id", "size"), "groups")
    drop(rows, nodes, roots)
    return out
