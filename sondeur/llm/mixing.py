"""Mixing sources to target weights by hierarchical budgeting over a domain, language and source tree.

A token budget flows down the tree by the nodes' weights.  A child takes no more than its subtree can give (its tokens
times `epochs`); what it can't take goes to its siblings by their weights, and leaves their parent only when the whole
parent is exhausted, so shortages are redistributed among siblings before ancestors.  Each leaf then reads its
documents in seeded epochs: an epoch orders them by md5 of "seed:epoch:doc_id", and the leaf takes whole epochs and
then the prefix of one more until its budget is met (the document that crosses it is the last).

The leaf's prefix is found as a cut key, from exact token sums of hash ranges and then of the one range that holds the
cut, so no leaf, however large, is sorted in one task, and documents are selected by one narrow pass that compares
their key with their leaf's cut.

Defined results: tokens are runs of other than white space; a null text has none.  A null language or source is a
branch of its own.  A null doc_id is ordered as the word null.  Rows without tokens are never taken.  Repeated rows
count and are taken each; rows that tie in doc_id are ordered by md5 of the text, and equal rows are taken together.
A node that the weights don't list weighs 1; one of weight 0 gets a budget only when its siblings are exhausted.  An empty table gives no rows.  Columns beside doc_id, text, lang and source are passed through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

SEED = "mix-1"
#: The budget as a share of the corpus's tokens, and how often a document may be taken at most.
BUDGET, EPOCHS = 0.8, 3
#: Domains by source, and the weights of the tree's nodes: domains, languages and sources.  What isn't listed weighs 1.
DOMAINS = {"reference": ("src0", "src1", "src2", "src3"), "forum": ("src4", "src5", "src6", "src7", "src8", "src9")}
REST = "web"
WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"reference": 3.0, "forum": 2.0, "web": 5.0},
    "lang": {"en": 6.0, "fr": 1.5, "de": 1.5, "es": 1.0},
    "source": {},
}
LEVELS = ("domain", "lang", "source")
#: Hash ranges of a leaf whose sums are taken first; their number bounds nothing but the size of a task.
_RANGE = 3


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def domain(source: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, members in DOMAINS.items():
        out = out.when(source.isin(*members), F.lit(name))
    return out.otherwise(F.lit(REST))


def _weight(level: str, value: Column, weights: dict[str, dict[str, float]]) -> Column:
    known = weights.get(level) or {}
    out = F.when(F.lit(False), F.lit(0.0))
    for name, w in known.items():
        out = out.when(value == name, F.lit(float(w)))
    return out.otherwise(F.lit(1.0))


def leaf_budgets(leaves: DataFrame, share: float = BUDGET, epochs: int = EPOCHS, weights: dict[str, dict[str, float]] = WEIGHTS) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with their budget.

    At each node, children sorted by capacity over weight saturate in that order; the rest share what is left by
    weight.  That is one window per level over as many rows as the tree has nodes.
    """
    tree = leaves.select(*LEVELS, "tokens", (F.col("tokens") * epochs).cast("double").alias("cap"))
    given = tree.agg((F.sum("tokens") * F.lit(float(share))).alias("budget"))
    above: tuple[str, ...] = ()
    for level in LEVELS:
        keys = [*above, level]
        nodes = tree.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, F.col(level), weights))
        parent = nodes.alias("n").join(given.alias("g"), _same(above)) if above else nodes.crossJoin(given)
        parent = parent.select(*[F.col(f"n.{k}") if above else F.col(k) for k in keys], "cap", "w", "budget")
        # children of no weight come last: they share what their siblings leave
        order = Window.partitionBy(*above).orderBy((F.col("w") <= 0).cast("int"), (F.col("cap") / F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)), F.col(level).asc_nulls_first())
        upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        w = F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)
        ranked = parent.withColumn("before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn("rest", F.sum(F.when(F.col("w") > 0, w).otherwise(0.0)).over(after)).withColumn("bare", F.sum(F.when(F.col("w") <= 0, 1.0).otherwise(0.0)).over(after))
        left = F.greatest(F.col("budget") - F.col("before"), F.lit(0.0))
        # a child is full if the level at which it would be is reached: cap/w <= left/(weights from here on)
        share_of = F.when(F.col("w") > 0, left * w / F.col("rest")).otherwise(left / F.col("bare"))
        ranked = ranked.withColumn("full", F.col("cap") <= share_of)
        held = Window.partitionBy(*above)
        zero = F.col("w") <= 0
        sated = ranked.withColumn("used", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(held)).withColumn("open", F.sum(F.when(~F.col("full") & ~zero, w).otherwise(0.0)).over(held)).withColumn("bare", F.sum(F.when(~F.col("full") & zero, 1.0).otherwise(0.0)).over(held))
        free = F.greatest(F.col("budget") - F.col("used"), F.lit(0.0))
        mine = F.when(F.col("full"), F.col("cap")).when(~zero, free * w / F.col("open")).when(F.col("open") == 0, free / F.col("bare")).otherwise(0.0)
        given = sated.select(*keys, mine.alias("budget"))
        above = tuple(keys)
    return tree.alias("t").join(given.alias("g"), _same(above)).select(*[F.col(f"t.{k}") for k in LEVELS], F.col("t.tokens").alias("tokens"), F.col("g.budget").alias("budget"))


def _same(keys: tuple[str, ...], a: str = "n", b: str = "g") -> Column:
    if not keys:
        return F.lit(True)
    left = "t" if len(keys) == len(LEVELS) else a
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _key(epoch: Column, seed: str) -> Column:
    """The place of a row in an epoch: fixed-width md5 and then what tells tied rows apart."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("__id").cast("string"), F.lit("null"))).cast("binary"))


def selection(docs: DataFrame, share: float = BUDGET, epochs: int = EPOCHS, seed: str = SEED, weights: dict[str, dict[str, float]] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): the measured rows of docs, and one row for each leaf with its whole epochs and its cut."""
    rows = docs.select(
        F.col("doc_id").alias("__id"), domain(F.col("source")).alias("domain"), "lang", "source", tokens(F.col("text")).alias("n"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("tie")
    )
    rows = stored(rows.where("n > 0"), "measured")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    budget = leaf_budgets(leaves, share, epochs, weights)
    # a budget within a millionth of whole epochs counts as whole, so that the order of sums doesn't matter
    whole = F.floor(F.col("budget") / F.col("tokens") + 1e-6).cast("int")
    plan = stored(budget.select(*LEVELS, "tokens", F.round("budget", 3).alias("budget"), whole.alias("whole"), F.greatest(F.round(F.col("budget") - whole * F.col("tokens"), 3), F.lit(0.0)).alias("rest")), "budgets")
    count = plan.count()
    order = small(plan, count)
    part = rows.alias("t").join(order.alias("g"), _same(LEVELS)).where("g.rest > 0").select(*[F.col(f"t.{k}") for k in LEVELS], "n", "tie", "__id", "rest", _key(F.col("whole") + 1, seed).alias("h"))
    ranges = part.groupBy(*LEVELS, "rest", F.substring("h", 1, _RANGE).alias("range")).agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cut_range = stored(ranges.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).where("before < rest AND before + n >= rest").select(*LEVELS, "range", "before"), "ranges")
    inside = part.alias("t").join(small(cut_range, count).alias("g"), _same(LEVELS) & (F.substring("t.h", 1, _RANGE) == F.col("g.range"))).select(*[F.col(f"t.{k}") for k in LEVELS], "h", "tie", "rest", "before", "n")
    run = Window.partitionBy(*LEVELS).orderBy("h", "tie").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = inside.withColumn("upto", F.col("before") + F.sum("n").over(run))
    cut = met.where("upto >= rest").groupBy(*LEVELS).agg(F.min(F.struct("h", "tie")).alias("cut"))
    # where rounding leaves the range's rows short of the rest, the leaf's whole epoch is taken
    cuts = plan.alias("t").join(cut.alias("g"), _same(LEVELS), "left").select(*[F.col(f"t.{k}") for k in LEVELS], "t.tokens", "t.budget", "t.whole", "t.rest", F.col("g.cut.h").alias("cut_h"), F.col("g.cut.tie").alias("cut_tie"))
    return rows, stored(cuts, "cuts")


def _taken(rows: DataFrame, cuts: DataFrame, seed: str) -> DataFrame:
    """rows (t) joined with their leaf's cut (g), and `copies`."""
    h = _key(F.col("g.whole") + 1, seed)
    inside = (F.col("g.rest") > 0) & (F.col("g.cut_h").isNull() | (h < F.col("g.cut_h")) | ((h == F.col("g.cut_h")) & (F.col("tie") <= F.col("g.cut_tie"))))
    return rows.alias("t").join(small(cuts, cuts.count()).alias("g"), _same(LEVELS)).withColumn("copies", F.col("g.whole") + inside.cast("int")).where("copies > 0")


def mixed(docs: DataFrame, share: float = BUDGET, epochs: int = EPOCHS, seed: str = SEED, weights: dict[str, dict[str, float]] = WEIGHTS) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) of every row that is taken: copies counts the epochs that take it."""
    rows, cuts = selection(docs, share, epochs, seed, weights)
    return _taken(rows, cuts, seed).select(F.col("__id").alias("doc_id"), "t.domain", "t.lang", "t.source", F.col("n").alias("n_tokens"), "copies")


def mixture(docs: DataFrame, share: float = BUDGET, epochs: int = EPOCHS, seed: str = SEED, weights: dict[str, dict[str, float]] = WEIGHTS) -> DataFrame:
    """The rows of docs that are taken, with all their columns, each as often as epochs take it."""
    _, cuts = selection(docs, share, epochs, seed, weights)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__id"), domain(F.col("source")).alias("domain"), F.col("lang"), F.col("source"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("tie"), F.col("text").rlike(r"\S").alias("has"))
    taken = _taken(own.where("has"), cuts, seed).select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"))
    return taken.select("__row.*")


def oracle() -> str:
    """mixed over the table documents, in DuckDB's SQL: one window over each leaf instead of cut keys."""
    member = " ".join(f"WHEN source IN ({', '.join(repr(x) for x in xs)}) THEN '{name}'" for name, xs in DOMAINS.items())
    steps = [
        f"base AS (SELECT doc_id, CASE {member} ELSE '{REST}' END AS domain, lang, source, coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS n, md5(coalesce(text, '')) AS tie FROM documents)",
        "rows AS (SELECT * FROM base WHERE n > 0)",
        f"tree AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, (sum(n) * {EPOCHS})::DOUBLE AS cap FROM rows GROUP BY 1, 2, 3)",
        f"g0 AS (SELECT sum(tokens) * {BUDGET}::DOUBLE AS budget FROM tree)",
    ]
    for k, level in enumerate(LEVELS):
        keys, above = ", ".join(LEVELS[: k + 1]), LEVELS[:k]
        weight = f"CASE {' '.join(f"WHEN {level} = '{v}' THEN {float(w)}" for v, w in WEIGHTS[level].items())} ELSE 1.0 END::DOUBLE" if WEIGHTS[level] else "1.0::DOUBLE"
        on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM g.{c}" for c in above) or "true"
        part = f"PARTITION BY {', '.join(above)}" if above else ""
        order = f"{part} ORDER BY cap / w, {level} NULLS FIRST"
        steps += [
            f"n{k} AS (SELECT {keys}, sum(cap) AS cap, {weight} AS w FROM tree GROUP BY {keys})",
            f"p{k} AS (SELECT n.*, g.budget FROM n{k} n JOIN g{k} g ON {on})",
            f"r{k} AS (SELECT *, greatest(budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) * w / sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM p{k})",
            f"s{k} AS (SELECT *, sum(CASE WHEN cap <= share THEN cap ELSE 0 END) OVER ({part}) AS used, sum(CASE WHEN cap <= share THEN 0 ELSE w END) OVER ({part}) AS open FROM r{k})",
            f"g{k + 1} AS (SELECT {keys}, CASE WHEN cap <= share THEN cap ELSE greatest(budget - used, 0) * w / open END AS budget FROM s{k})",
        ]
    same = " AND ".join(f"t.{c} IS NOT DISTINCT FROM g.{c}" for c in LEVELS)
    leaf = ", ".join(LEVELS)
    steps += [
        f"plan AS (SELECT t.*, round(g.budget, 3) AS budget, floor(g.budget / t.tokens + 1e-6)::INT AS whole, greatest(round(g.budget - floor(g.budget / t.tokens + 1e-6) * t.tokens, 3), 0) AS rest FROM tree t JOIN g3 g ON {same})",
        f"keyed AS (SELECT t.*, whole, rest, md5('{SEED}:' || (whole + 1)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM rows t JOIN plan g ON {same})",
        f"run AS (SELECT *, sum(n) OVER (PARTITION BY {leaf} ORDER BY h, tie RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(n) OVER (PARTITION BY {leaf}, h, tie) AS before FROM keyed)",
        "chosen AS (SELECT *, whole + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END AS copies FROM run)",
    ]
    return f"WITH {', '.join(steps)} SELECT doc_id, domain, lang, source, n AS n_tokens, copies::INT AS copies FROM chosen WHERE copies > 0"
