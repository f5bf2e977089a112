"""Looking up a query's terms in the dictionary: exact, by spelling, and by prefix.

Each step asks the dictionary for the few terms of one query; nothing else of the index is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SearchOptions
from ..operators.index import Index
from .query import GROUP, PHRASE, TERM, Part

#: The total weight that terms of an automatic expansion share.
EXPANDED = 0.5


def corrections(dictionary: DataFrame, word: str) -> DataFrame:
    """(term, df, distance) of the terms within a word's edit distance, best first: nearest, then most frequent, then by letters."""
    most = 1 if len(word) <= 4 else 2 if len(word) <= 8 else 3
    near = dictionary.where(F.abs(F.char_length("term") - len(word)) <= most).withColumn("distance", F.levenshtein(F.col("term"), F.lit(word), most))
    return near.where(F.col("distance") >= 0).orderBy("distance", F.desc("df"), "term")


def prefixed(dictionary: DataFrame, prefix: str, df: int | None, stop_words: frozenset[str] = frozenset()) -> DataFrame:
    """(term, df) of longer terms: stop words last, then by nearness of df to the prefix's own (or most frequent first), then by letters."""
    own = F.lit(2**32 - 1 if df is None else df)
    found = dictionary.where(F.col("term").startswith(prefix) & (F.col("term") != prefix))
    stop = F.col("term").isin(*sorted(stop_words)) if stop_words else F.lit(False)
    return found.orderBy(stop, F.abs(F.col("df") - own), "term")


def resolve(parts: list[Part], index: Index) -> list[Part]:
    """Give each term the dictionary's term: its own, or the best correction, or none.  Phrases need the terms that exist."""
    terms = [p for part in parts for p in part.walk() if p.kind == TERM and p.original is not None and not p.suffixed]
    ignored = index.analyzer.stop_words if index.config.ignore_stop_words else frozenset()
    known = index.frequencies([p.original for p in terms if p.original not in ignored])
    for p in terms:
        if p.original in ignored:
            p.term = None
        elif p.original in known:
            p.term = p.original
        else:
            p.term = None
            if not p.wildcard and index.analyzer.corrects(p.original):
                ask = lambda word=p.original: (best := corrections(index.dictionary, word).first()) and best["term"]
                if found := index.correction(p.original, ask):
                    p.term, p.corrected = found, True
                    p.forms = [*p.forms, found]
    for part in parts:
        for p in part.walk():
            if p.kind == PHRASE:
                for c in p.children or ():
                    c.mandatory = c.term is not None
    return parts


def _expand(part: Part, index: Index, limit: int, weighted: bool, used: list[Part]) -> None:
    """Turn a term into a group of itself and longer terms."""
    df = index.frequencies([part.original]).get(part.original)
    longer = [r["term"] for r in prefixed(index.dictionary, part.original, df, index.analyzer.stop_words).limit(limit).collect()]
    base = Part(TERM, original=part.original, term=part.term, forms=part.forms, wildcard=part.wildcard, auto_suffix=part.auto_suffix, corrected=part.corrected, weight=part.weight)
    if longer:
        base.suffixed = True
        if base.corrected:  # longer terms are a better guess than another spelling
            base.term, base.forms, base.corrected = None, [], False
    part.kind, part.original, part.term, part.forms = GROUP, None, None, []
    part.wildcard = part.auto_suffix = part.corrected = False
    part.weight = 1.0
    part.children = [base]
    taken = {p.term for u in used for p in u.walk() if p.term is not None}
    for term in longer:
        if term not in taken:
            weight = len(base.original) / len(term) * EXPANDED / len(longer) if weighted else base.weight
            part.children.append(Part(TERM, term=term, forms=[term], suffixed=True, weight=weight))


def expand(parts: list[Part], index: Index, options: SearchOptions) -> list[Part]:
    """Expand terms with a star, and the last term if its text doesn't end in a blank."""
    if not parts or options.max_suffix == 0:
        return parts

    def stars(some: list[Part]) -> None:
        for p in some:
            if p.kind == TERM and p.original is not None and not p.suffixed and p.wildcard:
                _expand(p, index, options.max_suffix, False, [])
            elif p.children:
                stars(p.children)

    stars(parts)
    last = parts[-1]
    if last.kind == TERM and last.original is not None and not last.suffixed and last.auto_suffix and not last.subtracted and not last.inverted:
        _expand(last, index, options.max_auto_suffix, True, parts[:-1])
    return parts
