"""Quality classifier (boosted trees) and quality rules (isolation forest), both over rule statistics of whole texts.

Documents with labels are measured once.  The classifier is fitted on at most MAX_LABELLED of them, drawn by hash among four
fifths; its threshold is calibrated on all labelled documents of the other fifth.  The rules' limits, medians and
deviations come from all good labelled documents and their threshold from all labelled ones, through histograms whose size the
data don't change; only the forest's random subsamples are drawn from at most MAX_LABELLED.  Then every document is scored in
one narrow pass without a shuffle.

Defined results: doc_id may be of any type that can be joined; a label's doc_id is cast to it.  A null, empty or blank
text scores 0 in the classifier and 1 in the rules, and is rejected by both.  A null doc_id is scored like any other, but no label
is its own.  Repeated rows are each scored, alike; in fitting a doc_id counts once, by the text of least statistics.  A
document with several labels counts as good if at least half of them are 1; null labels and labels of unknown documents
are left out.  Without labelled rows of both classes nothing but blank texts is rejected.  Columns beside doc_id and text
are ignored, or passed through unread by `only_good` and `only_ordinary`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .textstats import NAMES, statistics
from .trees import IsolationForest, calibrated, fit_boosted, fit_isolation

#: The most labelled documents that a model is fitted on.
MAX_LABELLED = 20_000
#: One labelled document in so many is held out of the classifier's fit, to calibrate its threshold.
HELD = 5
#: Steps of a histogram for each unit of log(1 + value), and of a score.
STEPS, SCORE_STEPS = 1 << 15, 1 << 11
#: The share of good labelled rows that a calibrated threshold may reject.
SPARE = 0.002

#: Statistics that the rules limit; texts' lengths are no reason to reject.
RULES = tuple(NAMES.index(x) for x in ("word_chars", "letters", "upper", "digits", "stops", "commas", "bangs", "symbols", "spaces", "repeated_lines", "distinct_words", "top_word", "distinct_pairs", "function_words"))
#: So many words of an ordinary text are added to each text's rates, for a few words are little evidence.
PRIOR_WORDS = 10


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, good, held, x) of every labelled document, one row for each doc_id: x are its statistics."""
    kind = dict(docs.dtypes)["doc_id"]
    marks = labels.select(F.col("doc_id").try_cast(kind).alias("id"), F.col("quality").cast("double").alias("q")).dropna().groupBy("id").agg((F.avg("q") >= 0.5).cast("double").alias("good"))
    marks = stored(marks, "marks")
    n, own = marks.count(), docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    few = small(marks, n)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], ["id", "x"])

    # a broadcast filter spares the texts without labels; where labels are too many for that, statistics are shuffled and not texts
    rows = own.join(few, "id", "left_semi") if few is not marks else own.where("id IS NOT NULL")
    found = rows.select("id", "body").mapInArrow(measure, f"id {kind}, x array<double>").groupBy("id").agg(F.min("x").alias("x"))
    return stored(found.join(few, "id").select("id", "good", (F.pmod(F.xxhash64("id"), F.lit(HELD)) == HELD - 1).alias("held"), "x"), "labelled")


def sample(rows: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, 1 for good) of at most `bound` rows of `labelled`: those with the smallest hashes, in their order."""
    found = rows.orderBy(F.xxhash64("id", F.lit("fit")), "id").limit(bound).select("good", "x").toArrow()
    return np.array(found["x"].to_pylist(), float).reshape(-1, len(NAMES)), found["good"].to_numpy()


def histogram(rows: DataFrame, values: Callable[[np.ndarray], np.ndarray], place: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(column, good, step, rows) by place: how many rows of `labelled` have each step in each column of values(x).

    Counts are added up where the rows are, so the driver gets one row for each step, however many documents there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            at = place(values(x)).astype(np.int64)
            key = np.column_stack([np.tile(np.arange(at.shape[1]), len(x)), np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), at.shape[1]), at.ravel()])
            own, n = np.unique(key, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(own[:, 2]), pa.array(n)], ["col", "good", "step", "n"])

    counts = rows.select("good", "x").mapInArrow(run, "col bigint, good bigint, step bigint, n bigint").groupBy("col", "good", "step").agg(F.sum("n").alias("n"))
    t = counts.toArrow().sort_by([("col", "ascending"), ("step", "ascending"), ("good", "ascending")])
    return tuple(t[c].to_numpy() for c in ("col", "good", "step", "n"))


def _logarithmic(v: np.ndarray) -> np.ndarray:
    return np.rint(np.log1p(np.maximum(v, 0)) * STEPS)


def _value(step: np.ndarray) -> np.ndarray:
    return np.expm1(step / STEPS)


def spread(rows: DataFrame, values: Callable[[np.ndarray], np.ndarray], shares: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(quantiles by share and column, standard deviation by column) of values over all of rows, as fine as the histogram."""
    col, _, step, n = histogram(rows, values, _logarithmic)
    quantiles, deviation = [], []
    for c in range(int(col.max()) + 1 if len(col) else 0):
        v, k = _value(step[col == c]), n[col == c]
        upto, total = np.cumsum(k), k.sum()
        quantiles.append([v[np.searchsorted(upto, q * (total - 1), side="right")] for q in shares])
        mean = (v * k).sum() / total
        deviation.append(np.sqrt((k * (v - mean) ** 2).sum() / total))
    return np.array(quantiles).T, np.array(deviation)


def threshold(rows: DataFrame, score: Callable[[np.ndarray], np.ndarray], spare: float) -> float:
    """`calibrated` over all of rows, the scores taken in steps."""
    _, good, step, n = histogram(rows, lambda x: score(x)[:, None], lambda v: np.rint(v * SCORE_STEPS))
    return calibrated(step / SCORE_STEPS, good < 0.5, spare, n)


Scorer = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def classifier(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Scorer:
    """Texts to (probability of good, accepted)."""
    rows = labelled(docs, labels)
    x, good = sample(rows.where("NOT held"), bound)
    model = fit_boosted(x, good)
    cut = float("inf")
    if len(x) and good.min() < good.max():
        cut = threshold(rows.where("held"), lambda v: np.clip(-model.total(v), -32, 32), SPARE)
        # the fifth may lack a class that the rest has; and no threshold is stricter than even odds
        cut = max(cut, 0.0) if np.isfinite(cut) else 0.0

    def score(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        s = statistics(texts)
        margin = model.total(s)
        blank = s[:, 1] == 0
        return np.where(blank, 0.0, 1 / (1 + np.exp(-margin))), (-margin <= cut) & ~blank

    return score


def _rates(x: np.ndarray, usual: np.ndarray) -> np.ndarray:
    words = np.expm1(x[:, [1]])
    return ((x * words + usual * PRIOR_WORDS) / (words + PRIOR_WORDS))[:, RULES]


def rules(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Scorer:
    """Texts to (isolation score, accepted).

    Each rule allows the middle 99.6 % of good labelled texts; its statistic is how far a text lies outside, in good
    texts' standard deviations on a log scale.  The forest parts labelled texts by these, and the threshold on its
    score is calibrated on their labels.
    """
    rows = labelled(docs, labels)
    fine = rows.where("good = 1")
    middle, _ = spread(fine, lambda x: x, (0.5,))
    usual = middle[0] if len(middle) else np.zeros(len(NAMES))
    limits, deviation = spread(fine, lambda x: _rates(x, usual), (0.002, 0.998))
    low, high = limits if len(limits) else np.zeros((2, len(RULES)))
    unit = np.maximum(deviation, 1e-3) if len(deviation) else np.full(len(RULES), 1e-3)

    def excess(s: np.ndarray) -> np.ndarray:
        r = _rates(s, usual)
        return np.log1p(np.maximum(np.maximum(low - r, r - high), 0) / unit)

    forest: IsolationForest = fit_isolation(excess(sample(rows, bound)[0]))
    cut = threshold(rows, lambda x: forest.score(excess(x)) * 32, SPARE) / 32

    def score(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        s = statistics(texts)
        value = forest.score(excess(s))
        blank = s[:, 1] == 0
        return np.where(blank, 1.0, value), (value <= cut) & ~blank

    return score


def scored(docs: DataFrame, scorer: Scorer, name: str) -> DataFrame:
    """(doc_id, <name>, keep) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, keep = scorer(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value.round(6)), pa.array(keep)], ["doc_id", name, "keep"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {name} double, keep boolean")


def accepted(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of docs that the scorer accepts, with all their columns; texts alone go through Python."""

    @F.arrow_udf("boolean")
    def keep(texts: pa.Array) -> pa.Array:
        return pa.array(scorer(texts)[1])

    return docs.where(keep("text"))


def quality_classifier(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, p_good, keep): p_good is the probability that a document is good."""
    return scored(docs, classifier(docs, labels, bound), "p_good")


def quality_rules(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, anomaly, keep): anomaly is the isolation score."""
    return scored(docs, rules(docs, labels, bound), "anomaly")


def only_good(docs: DataFrame, train: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier, fitted on labelled rows of train, rejects."""
    return accepted(docs, classifier(train, labels))


def only_ordinary(docs: DataFrame, train: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the rules, fitted on labelled rows of train, reject."""
    return accepted(docs, rules(train, labels))
