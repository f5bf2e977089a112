"""Analyzers: text to terms.

The JVM finds a text's words, by built-in expressions; what a word becomes (folded, stripped, stemmed) is worked out in
Python once for each distinct word of a batch.  Queries go through the same functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import IndexConfig
from . import folding, han
from .stemmer import stemmer

STOP_WORDS = (
    "their there these into such that then they this will with and are but for not the was an as at be by if in is it no of on or to a".split()
)  # the usual list of search libraries

_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII_SEPARATORS = "!\"#&()*+,-./:;<=>?@[\\]^`{|}~"
#: Typographic marks that separate words: brackets, quotes, fullwidth and small forms, dashes, CJK stops.
_MARKS = (
    "\xab\xbb–—‚“”„•…‸‹›‼⁄⁅⁆⁇⁈⁉⁎⁏⁓⁺⁼⁽⁾₊₌₍₎❛❜❝❞❨❩❪❫❬❭❮❯❰❱❲❳❴❵⸨"
    "⸩。《》！＂＃＆（）＊＋，．／：；＜＝＞？＠［＼］＾｛｝～"
)
SEPARATORS = _ASCII_SEPARATORS + _MARKS
#: Marks that are dropped from within words; those that also separate never get there.
INTRA = "'_‐‑‒‘’‛′″‵‶⁻₋＇－＿"
#: Stands for a sentence's end among a text's words.
GAP = "\x01"


def _cls(chars: str) -> str:
    """chars escaped for use within [ ] in Java, RE2 and Python alike."""
    return "".join("\\" + c if c in "[]\\^-&~|#" else c for c in chars)


_SENTENCE = f"[.,;?!][{_BLANKS}]+"
_APART = _cls(SEPARATORS) + _BLANKS + GAP
_LATIN = _cls("".join(c for c in SEPARATORS if ord(c) < 256)) + "\t\n\x0b\x0c\r \x85\xa0" + GAP
_RARE = _cls("".join(c for c in SEPARATORS if ord(c) >= 256)) + "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Ranges that hold all rare separators: a quick test of whether a text has any.
_RARE_BLOCKS = "[\u1680\u2000-\u2bff\u2e00-\u303f\uff00-\uffef]"
#: In SQL: the longest run from a letter or digit to a letter or digit without separators.
WORD = f"[a-z0-9](?:[^{_APART}]*[a-z0-9])?"


@dataclass(frozen=True)
class Analyzer:
    config: IndexConfig

    @cached_property
    def stop_words(self) -> frozenset[str]:
        return frozenset(STOP_WORDS if self.config.stop_words is None else self.config.stop_words)

    @cached_property
    def stem(self) -> Callable[[str], str] | None:
        return stemmer(self.config.stem_language) if self.config.analyzer == "ascii_stemmer" else None

    @property
    def chinese(self) -> bool:
        return self.config.analyzer == "chinese"

    # Indexing

    def words(self, text: Column) -> Column:
        """array<string> of a text's words in lower case as they stand, each sentence followed by GAP."""
        low = F.lower(F.regexp_replace(F.replace(text, F.lit(GAP), F.lit(" ")), han.SENTENCE if self.chinese else _SENTENCE, GAP))
        even = F.when(low.rlike(_RARE_BLOCKS), F.regexp_replace(low, f"[{_RARE}]", " ")).otherwise(low)
        one = han.PIECE if self.chinese else ""
        out = F.regexp_extract_all(F.concat(even, F.lit(GAP)), F.lit(f"({one}[^{_LATIN}{han.EXCLUDED if self.chinese else ''}]+|{GAP})"), F.lit(1))
        return F.coalesce(out, F.array().cast("array<string>"))

    def term(self, word: str) -> str | None:
        """What the index holds of a word, if anything."""
        out = word if word.isascii() and word.isalnum() else self.filtered(folding.fold(word))
        if self.config.ignore_stop_words and out in self.stop_words:
            return None
        if self.stem and out:
            out = self.stem(out)
        return out if 0 < len(out.encode()) <= min(self.config.max_term_len, 250) else None

    # Queries

    def split(self, text: str) -> list[tuple[int, str]]:
        """(offset, piece) of words and single separators, in order."""
        out: list[tuple[int, str]] = []
        start = 0
        for i, c in enumerate(text):
            if is_separator(c) or (self.chinese and (han.is_han(c) or han.is_mark(c))):
                out += [(start, text[start:i])] if start < i else []
                out.append((i, c))
                start = i + 1
        return out + ([(start, text[start:])] if start < len(text) else [])

    def is_term(self, piece: str) -> bool:
        return not (len(piece) == 1 and (is_separator(piece) or (self.chinese and han.is_mark(piece))))

    def inflections(self, word: str) -> tuple[str, list[str]]:
        """(term, forms in which it may stand in a text) of a query's word."""
        forms = [word]
        folded = folding.fold(word)
        if folded != word:
            forms.append(folded)
        if "'" in folded:
            forms.append(folded.replace("'", "’"))
        term = self.filtered(folded)
        if term and term != folded:
            forms.append(term)
        if self.stem and term:
            stemmed = self.stem(term)
            if stemmed != term:
                forms.append(stemmed)
            term = stemmed
        return term, list(dict.fromkeys(forms))

    def filtered(self, folded: str) -> str:
        term = folded.translate({ord(c): None for c in INTRA + "-*"})
        if self.chinese:
            return han.simplified(term)
        return re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", term)

    def ends_operator(self, c: str) -> bool:
        """Whether an operator may follow c."""
        return c in " \t\n\x0c\r" or (self.chinese and han.is_han(c))

    def corrects(self, word: str) -> bool:
        return not (self.chinese and len(word) == 1 and han.is_han(word))


#: Analyzers by the name that a configuration gives: ascii, ascii_stemmer and chinese are Analyzer's own, others are registered.
REGISTERED: dict[str, type[Analyzer]] = {}


def register(name: str, kind: type[Analyzer]) -> None:
    """Let configurations name an analyzer: a subclass of Analyzer that overrides `words`, `term`, `inflections` or whatever else differs."""
    REGISTERED[name] = kind


def analyzer_of(config: IndexConfig) -> Analyzer:
    if config.analyzer in ("ascii", "ascii_stemmer", "chinese"):
        return Analyzer(config)
    if config.analyzer not in REGISTERED:
        raise ValueError(f"no analyzer {config.analyzer} is registered")
    return REGISTERED[config.analyzer](config)


@cache
def _blank_or_separator() -> re.Pattern[str]:
    return re.compile(f"[{_BLANKS}{_cls(SEPARATORS)}]")


def is_separator(c: str) -> bool:
    return bool(_blank_or_separator().match(c))


# SQL of the same analysis, for comparison.


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def prepared_sql(text: str) -> str:
    out = f"lower(regexp_replace(translate({text}, chr(1), ' '), {sql_text(_SENTENCE)}, chr(1), 'g'))"
    single = [(a, b) for a, b in zip(*folding.single(), strict=True) if a not in SEPARATORS and a not in INTRA]
    out = f"translate({out}, {sql_text(''.join(a for a, _ in single) + INTRA)}, {sql_text(''.join(b for _, b in single))})"
    for a, b in ((a, b) for a, b in folding.multiple() if a not in SEPARATORS and b.isalnum()):
        out = f"replace({out}, {sql_text(a)}, {sql_text(b)})"
    return out


def terms_sql(text: str, max_len: int = 80, stop_words: tuple[str, ...] = ()) -> str:
    """A list of terms with nulls for gaps."""
    stops = f" AND t NOT IN ({', '.join(map(sql_text, sorted(stop_words)))})" if stop_words else ""
    found = f"regexp_extract_all(concat({prepared_sql(text)}, chr(1)), {sql_text(WORD + '|' + GAP)})"
    return f"list_transform(list_filter({found}, lambda t: t = chr(1) OR (strlen(t) <= {max_len}{stops})), lambda t: nullif(t, chr(1)))"
