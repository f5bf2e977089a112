"""A resolved query as one lazy plan over the index.

Each part becomes (doc_id, score, fields, pos): fields are the ids of the fields it matches in, pos its positions as
(p, f), kept only where a phrase, proximity or a field above needs them.  A part's children are tagged, united and
grouped once by document, whatever their number; nothing is joined but all documents, for inverted parts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SearchOptions
from ..operators import proximity
from ..operators.index import Index
from .query import GROUP, PHRASE, Part

MAJOR, MINOR = 0.7, 0.3


def idf(n: float, df: float) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def field_score(tf: Column, length: Column, mean: float, k: float, b: float, weight: float) -> Column:
    """BM25 of one field, without idf."""
    return tf * (k + 1) / (tf + k * (1 - b + b * length / mean)) * weight if mean else F.lit(0.0)


def soft_max(scores: list[Column]) -> Column:
    """The best field's score and a share of the others'."""
    if len(scores) == 1:
        return scores[0] * MAJOR
    top = F.greatest(*scores)
    rest = reduce(lambda a, b: a + b, scores) - top
    return MAJOR * top + MINOR * rest / (len(scores) - 1)


def _placed(i: int) -> Column:
    """A posting's positions in a field, with the field."""
    return F.transform(f"pos_{i}", lambda p: F.struct(p.cast("int").alias("p"), F.lit(i).alias("f")))


@dataclass
class Compiler:
    index: Index
    options: SearchOptions

    def __post_init__(self) -> None:
        self.config = self.index.config
        self.n, self.means = self.index.stats
        self.proximity = self.options.proximity and self.config.with_positions

    def empty(self) -> DataFrame:
        return self.index.lengths.where(F.lit(False)).select("doc_id", *[F.lit(None).cast(t).alias(n) for n, t in (("score", "double"), ("fields", "array<int>"), ("pos", "array<struct<p:int,f:int>>"))])

    def query(self, parts: list[Part]) -> DataFrame:
        """(doc_id, score) of a query's documents."""
        terms = sorted({p.term for part in parts for p in part.walk() if p.term is not None})
        self.df = self.index.frequencies(terms)
        self.base = self.index.scan([t for t in terms if t in self.df])
        if not parts:
            return self.empty().select("doc_id", "score")
        return self.node(parts, 1.0, "ROOT", False).select("doc_id", "score")

    # Parts

    def part(self, p: Part, weight: float, need_pos: bool) -> DataFrame:
        weight *= p.weight
        if p.children is not None:
            out = self.node(p.children, weight, p.kind, need_pos)
        elif p.term is not None and p.term in self.df:
            out = self.term(p.term, weight, need_pos)
        else:
            out = self.empty()
        if p.field_name is not None and (f := self.config.field_id(p.field_name)) is not None:
            out = out.where(F.array_contains("fields", f)).select("doc_id", "score", F.array(F.lit(f)).alias("fields"), F.filter("pos", lambda x: x["f"] == f).alias("pos"))
        return self.inverted(out, weight) if p.inverted else out

    def term(self, term: str, weight: float, need_pos: bool) -> DataFrame:
        scored = self.config.scored
        tf = [F.col(f"tf_{i}").cast("double") for i in range(len(scored))]
        scores = [F.when(tf[i] > 0, field_score(tf[i], F.col(f"len_{i}"), self.means[i], f.k, f.b, f.weight)).otherwise(0.0) for i, f in enumerate(scored)]
        fields = F.filter(F.array(*[F.when(F.col(f"tf_{i}") > 0, F.lit(i)) for i in range(len(scored))]), lambda x: x.isNotNull())
        pos = F.lit(None).cast("array<struct<p:int,f:int>>")
        if need_pos and self.config.with_positions:
            pos = F.flatten(F.array(*[_placed(i) for i in range(len(scored))]))
        score = soft_max(scores) * idf(self.n, self.df[term]) * weight
        return self.base.where(F.col("term") == term).select("doc_id", score.alias("score"), fields.alias("fields"), pos.alias("pos"))

    def inverted(self, matched: DataFrame, weight: float) -> DataFrame:
        """All other documents, alike in score: as if a term stood once in each."""
        ids = matched.select("doc_id").distinct()  # one exchange, which the count uses again
        others = self.index.lengths.select("doc_id").join(ids, "doc_id", "left_anti")
        count = ids.agg((F.lit(self.n) - F.count("*")).alias("df"))
        score = F.log(1 + (F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * weight
        return others.crossJoin(count).select("doc_id", score.alias("score"), F.array().cast("array<int>").alias("fields"), F.array().cast("array<struct<p:int,f:int>>").alias("pos"))

    def node(self, children: list[Part], weight: float, kind: str, need_pos: bool) -> DataFrame:
        phrase = kind == PHRASE
        if not children:
            return self.empty()
        near = [not (c.suffixed or c.inverted) and (not phrase or c.mandatory) for c in children]
        total = sum(not c.subtracted for c in children)
        mandatory = sum(c.mandatory for c in children)
        t = sum(near)
        least = max(2, t if phrase else math.ceil(t / 2))
        rank = t >= least and self.config.with_positions and (self.proximity or phrase)
        keep = need_pos or rank
        if phrase and t > 1 and t == len(children) and self._one_term(children):
            return self.repeated(children, weight)
        tagged = [
            self.part(c, weight, keep).select("doc_id", "score", "fields", "pos", F.lit(i).alias("i"), F.lit(c.mandatory).alias("must"), F.lit(c.subtracted).alias("not"), F.lit(near[i]).alias("near"))
            for i, c in enumerate(children)
        ]
        rows = reduce(DataFrame.unionByName, tagged)
        wanted = ~F.col("not")
        aggs = [
            F.sum(F.when(wanted, F.col("score"))).alias("score"),
            F.count(F.when(wanted, 1)).alias("matched"),
            F.count(F.when(wanted & F.col("must"), 1)).alias("musts"),
            F.max("not").alias("out"),
        ]
        if kind == GROUP or phrase:
            aggs.append(F.array_distinct(F.flatten(F.collect_list(F.when(wanted, F.col("fields"))))).alias("fields"))
        if rank:
            aggs.append(F.sort_array(F.collect_list(F.when(F.col("near"), F.struct("i", "pos")))).alias("lists"))
        elif need_pos:
            aggs.append(F.array_distinct(F.flatten(F.collect_list(F.when(wanted, F.col("pos"))))).alias("all_pos"))
        if rank and need_pos and not phrase:
            aggs.append(F.array_distinct(F.flatten(F.collect_list(F.when(wanted, F.col("pos"))))).alias("all_pos"))
        found = rows.groupBy("doc_id").agg(*aggs)
        none = F.lit(None).cast("array<struct<p:int,f:int>>")
        if phrase and t > 1:
            return self.phrase(found.where(F.size("lists") == t), t)
        kept = found.where(~F.col("out") & (F.col("matched") > 0) & (F.col("musts") == mandatory))
        part = F.col("matched") / F.lit(float(max(total, 1)))
        score = F.col("score") * part * part
        if rank:
            lists = F.transform("lists", lambda x: F.array_sort(F.transform(x["pos"], lambda q: q["p"])))
            near_enough = F.size("lists") >= least
            score = score * F.when(near_enough, proximity.factor(lists, t, least)).otherwise(1.0)
        fields = F.col("fields") if kind == GROUP or phrase else F.array().cast("array<int>")
        return kept.select("doc_id", score.alias("score"), fields.alias("fields"), (F.col("all_pos") if need_pos else none).alias("pos"))

    def _one_term(self, children: list[Part]) -> bool:
        """Whether all children are one term of the index."""
        first = children[0]
        plain = all(c.children is None and c.field_name is None and not c.subtracted for c in children)
        return plain and first.term in self.df and len({(c.term, c.weight) for c in children}) == 1

    def repeated(self, children: list[Part], weight: float) -> DataFrame:
        """A phrase of one term again and again: a document's only posting holds all that it needs, so nothing is grouped or shuffled."""
        rows = self.term(children[0].term, weight * children[0].weight, True)
        lists = F.array(*[F.struct(F.lit(i).alias("i"), F.col("pos")) for i in range(len(children))])
        score = reduce(lambda a, b: a + b, [F.col("score")] * len(children))
        return self.phrase(rows.select("doc_id", score.alias("score"), lists.alias("lists")), len(children))

    def phrase(self, found: DataFrame, terms: int) -> DataFrame:
        """Documents in which each term stands one position after the term before it; a phrase's positions are its starts."""
        shifted = F.transform("lists", lambda x, i: F.transform(x["pos"], lambda q: q["p"] - i.cast("int")))
        starts = F.aggregate(F.slice(shifted, 2, terms), F.element_at(shifted, 1), lambda a, b: F.array_intersect(a, b))
        held = found.withColumn("starts", starts).where(F.size("starts") > 0)
        first = F.element_at("lists", 1)["pos"]
        pos = F.filter(first, lambda q: F.array_contains("starts", q["p"]))
        return held.select("doc_id", (F.col("score") * proximity.phrase_factor(terms)).alias("score"), F.array_distinct(F.transform(pos, lambda q: q["f"])).alias("fields"), pos.alias("pos"))


def compile_query(parts: list[Part], index: Index, options: SearchOptions) -> DataFrame:
    return Compiler(index, options).query(parts)
