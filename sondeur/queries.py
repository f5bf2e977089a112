"""The engine's queries over the driver's tables, each with SQL of the same result where SQL can express it.

All run over whole tables.  Indexes are stored once for a session and folder of tables, as they would be in use.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FieldConfig, IndexConfig, SearchOptions
from .functions.analysis import GAP, STOP_WORDS, Analyzer, prepared_sql, sql_text, terms_sql
from .operators import incremental, results
from .operators.index import Index, build_index, number, one_zone, read_index, term_counts, term_frequencies, tokens, zones_of
from .operators.search import Query, days, facet_filters, facet_values, search
from .plans.resolve import corrections, prefixed
from .sources.files import Loaders, csv_zones, json_column, load_folder
from .sources.html import html_zones
from .storage import fresh, put, remove

Run = Callable[[SparkSession, str], DataFrame]

DOCUMENTS = IndexConfig(
    fields=(FieldConfig("body", 1.0), FieldConfig("lang", storage=("enum",)), FieldConfig("source", storage=("enum",)), FieldConfig("quality", storage=("enum",)), FieldConfig("n_chars", storage=("i64",))),
    buckets=16,
)
PARTS = IndexConfig(
    fields=(FieldConfig("p_name", 2.0, 1.2, 0.15), FieldConfig("p_type", 1.5, 1.2, 0.25), FieldConfig("p_brand", 1.0), FieldConfig("p_size", storage=("i64",))), buckets=4,
)
PLAIN = SearchOptions(max_auto_suffix=0, max_suffix=0, proximity=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a collection, with the quality of those that are labelled."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("quality"))
    docs = table(spark, sf_dir, "documents")
    return docs.join(labels, "doc_id", "left").select("doc_id", one_zone("body", F.col("text")).alias("zones"), "lang", "source", "n_chars", "quality")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select(F.col("p_partkey").alias("doc_id"), zones_of({c: F.col(c) for c in ("p_name", "p_type", "p_brand")}).alias("zones"), "p_size")


_indexes: dict[tuple[str, str, str], Index] = {}


def _index(spark: SparkSession, sf_dir: str, name: str, collection: Run, config: IndexConfig) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _indexes:
        _indexes[key] = build_index(collection(spark, sf_dir), config).write(fresh(spark, f"index-{name}"))
    return _indexes[key]


def document_index(spark: SparkSession, sf_dir: str) -> Index:
    return _index(spark, sf_dir, "documents", documents, DOCUMENTS)


def part_index(spark: SparkSession, sf_dir: str) -> Index:
    return _index(spark, sf_dir, "parts", parts, PARTS)


# SQL of the same, built by hand from the definitions and not from the plans.

_TOKENS = f"""base AS (SELECT doc_id, {terms_sql('text')} AS t FROM documents),
tok AS (SELECT doc_id, term, pos FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM base) WHERE term IS NOT NULL),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
dict AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
len AS (SELECT d.doc_id, coalesce(l.n, 0) AS len FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY ALL) l USING (doc_id)),
st AS (SELECT count(*) AS n, sum(len) / count(*) AS mean FROM len)"""
_FIELDS = (("p_name", 2.0, 0.15), ("p_type", 1.5, 0.25), ("p_brand", 1.0, 0.75))


def _part_tokens() -> str:
    flat = " || ".join(f"CASE WHEN {c} IS NULL THEN [] ELSE list_transform({terms_sql(c)}, lambda x: CASE WHEN x IS NULL THEN NULL ELSE {{'f': {i}, 't': x}} END) || list_transform(range(10), lambda x: NULL) END" for i, (c, _, _) in enumerate(_FIELDS))
    return f"""base AS (SELECT p_partkey AS doc_id, {flat} AS t FROM part),
tok AS (SELECT doc_id, x.f AS f, x.t AS term, pos FROM (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) - 1 AS pos FROM base) WHERE x IS NOT NULL),
post AS (SELECT term, doc_id, f, count(*) AS tf FROM tok GROUP BY ALL),
dict AS (SELECT term, count(DISTINCT doc_id) AS df FROM post GROUP BY ALL),
len AS (SELECT doc_id, f, count(*) AS len FROM tok GROUP BY ALL),
n AS (SELECT count(*) AS n FROM part),
st AS (SELECT f, sum(len) / any_value(n) AS mean, any_value(n) AS n FROM len, n GROUP BY f)"""


def _idf(n: str, df: str) -> str:
    return f"ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5))"


def _term(term: str, weight: float = 1.0) -> str:
    """(doc_id, score) of a term over the documents."""
    return f"SELECT doc_id, 0.7 * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) * {_idf('n', 'df')} * {weight!r} AS score FROM post JOIN dict USING (term) JOIN len USING (doc_id), st WHERE term = {sql_text(term)}"


def _part_term(term: str, weight: float = 1.0) -> str:
    """The same over three fields, by the soft maximum."""
    k = "CASE f " + " ".join(f"WHEN {i} THEN {w} * tf * 2.2 / (tf + 1.2 * ({1 - b} + {b} * len / mean))" for i, (_, w, b) in enumerate(_FIELDS)) + " END"
    return f"SELECT doc_id, (0.7 * max(s) + 0.3 * (sum(s) - max(s)) / 2) * {_idf('any_value(n)', 'any_value(df)')} * {weight!r} AS score FROM (SELECT doc_id, df, st.n AS n, {k} AS s FROM post JOIN dict USING (term) JOIN len USING (doc_id, f) JOIN st USING (f) WHERE term = {sql_text(term)}) GROUP BY doc_id"


def _node(*children: tuple[str, str]) -> str:
    """A group of (SQL, operator) with operator "", "+" or "-": optional, mandatory, subtracted."""
    total = sum(op != "-" for _, op in children)
    rows = " UNION ALL ".join(f"SELECT doc_id, score, {op == '+'} AS must, {op == '-'} AS bad FROM ({sql})" for sql, op in children)
    need = sum(op == "+" for _, op in children)
    return f"SELECT doc_id, sum(score) FILTER (NOT bad) * (count(*) FILTER (NOT bad) / {float(total)}) ** 2 AS score FROM ({rows}) GROUP BY doc_id HAVING NOT bool_or(bad) AND count(*) FILTER (must) = {need} AND count(*) FILTER (NOT bad) > 0"


def _others(sql: str, docs: str = "SELECT doc_id FROM documents", n: str = "(SELECT n FROM st)", weight: float = 1.0) -> str:
    return f"SELECT doc_id, {_idf(n, 'count(*) OVER ()')} * {weight!r} AS score FROM ({docs}) WHERE doc_id NOT IN (SELECT doc_id FROM ({sql}))"


def _phrase(*words: str) -> str:
    scores = " UNION ALL ".join(_term(w) for w in words)
    joins = " ".join(f"JOIN tok t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = {sql_text(w)}" for i, w in enumerate(words) if i)
    n = len(words)
    return f"SELECT doc_id, sum(score) * {1 + (2.5 + 0.5 * n) / (4 + n - 1)!r} AS score FROM ({scores}) WHERE doc_id IN (SELECT t0.doc_id FROM tok t0 {joins} WHERE t0.term = {sql_text(words[0])}) GROUP BY doc_id"


def _scored(node: str, ctes: str = _TOKENS) -> str:
    return f"WITH {ctes} SELECT doc_id, round(score, 6) AS score FROM ({node})"


QUERIES: dict[str, Run] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def keep(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _register(name: str, text: str, sql: str | None, index: Callable[[SparkSession, str], Index] = document_index, options: SearchOptions = PLAIN, shape: Callable[[Query], DataFrame] | None = None) -> None:
    """A search, whose result is all its documents with their scores unless shaped otherwise."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search(index(spark, sf_dir), text, options)
        return shape(found) if shape else _rounded(found.matches.select("doc_id", "score"))

    run.__name__ = name
    query(sql)(run)


# Analysis

def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts alone, for what needs no facets."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", one_zone("body", F.col("text")).alias("zones"))


def _doc_tokens(spark: SparkSession, sf_dir: str, config: IndexConfig = DOCUMENTS) -> DataFrame:
    return tokens(_texts(spark, sf_dir), config)


@query(f"WITH {_TOKENS} SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL")
def tok_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_tokens(spark, sf_dir).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"WITH {_TOKENS} SELECT doc_id, pos, term FROM tok")
def tok_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_tokens(spark, sf_dir).select("doc_id", "pos", "term")


@query(f"SELECT doc_id, len({terms_sql('text')}) - len(list_filter({terms_sql('text')}, lambda x: x IS NOT NULL)) AS sentences FROM documents")
def tok_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", Analyzer(DOCUMENTS).words(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size(F.filter("t", lambda x: x == GAP)).alias("sentences"))


@query(f"WITH w AS (SELECT lang, unnest({terms_sql('text')}) AS term FROM documents) SELECT lang, term, count(*) AS n FROM w WHERE term IS NOT NULL GROUP BY ALL")
def tok_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(_texts(spark, sf_dir), DOCUMENTS, by="lang").select("lang", "term", F.col("cf").alias("n"))


@query(f"WITH w AS (SELECT doc_id, unnest({terms_sql('text', 6)}) AS term FROM documents) SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM w WHERE term IS NOT NULL GROUP BY ALL")
def tok_maxlen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(_texts(spark, sf_dir), IndexConfig(fields=DOCUMENTS.fields, max_term_len=6))


@query(f"WITH w AS (SELECT doc_id, unnest({terms_sql('text', 80, tuple(STOP_WORDS))}) AS term FROM documents) SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM w WHERE term IS NOT NULL GROUP BY ALL")
def tok_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(_texts(spark, sf_dir), IndexConfig(fields=DOCUMENTS.fields, ignore_stop_words=True))


@query()
def tok_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems are beyond SQL; the tests hold them against the stemmer, word by word."""
    return term_counts(_texts(spark, sf_dir), IndexConfig(fields=DOCUMENTS.fields, analyzer="ascii_stemmer"))


def _han_sql() -> str:
    from .functions import analysis, han

    found = prepared_sql("text").replace(sql_text(analysis._SENTENCE), sql_text(han.SENTENCE))
    pattern = f"[{han._HAN}]|{analysis.GAP}|[^{analysis._APART}{han._MARKS}{han._HAN}]+"
    return f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all({found}, {sql_text(pattern)})) AS term FROM documents) SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM w WHERE term != chr(1) AND strlen(term) <= 80 GROUP BY ALL"


@query(_han_sql())
def tok_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(_texts(spark, sf_dir), IndexConfig(fields=DOCUMENTS.fields, analyzer="chinese"))


_LETTERS, _GLYPHS = "abcdefghijklm", "萬東絲們我他書學車門馬見長"


def _han_letters_sql() -> str:
    from .functions import han

    pairs = han.table()
    found = _han_sql().replace("prepared", "").split("WITH w AS (SELECT doc_id, unnest(", 1)[1].split(") AS term FROM documents)", 1)[0].replace("text", "han", 1)
    own = f"translate(term, {sql_text(''.join(pairs))}, {sql_text(''.join(pairs.values()))})"
    made = f"SELECT doc_id, translate(lower(text), {sql_text(_LETTERS)}, {sql_text(_GLYPHS)}) AS han FROM documents"
    return f"WITH d AS ({made}), w AS (SELECT doc_id, unnest({found}) AS raw FROM d), t AS (SELECT doc_id, {own.replace('term', 'raw')} AS term FROM w WHERE raw != chr(1)) SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM t WHERE strlen(term) <= 80 GROUP BY ALL"


@query(_han_letters_sql())
def tok_chinese_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with half of their letters as Han characters, traditional ones among them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", one_zone("body", F.translate(F.lower("text"), _LETTERS, _GLYPHS)).alias("zones"))
    return term_frequencies(docs, IndexConfig(fields=(FieldConfig("body", 1.0),), analyzer="chinese"))


# The index's tables


@query(f"WITH {_TOKENS} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tok GROUP BY ALL")
def idx_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_index(spark, sf_dir).postings
    return rows.select("term", "doc_id", F.col("tf_0").cast("bigint").alias("tf"), F.array_join(F.col("pos_0").cast("array<string>"), " ").alias("positions"))


@query(f"WITH {_TOKENS} SELECT term, df FROM dict")
def idx_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).dictionary.select("term", "df")


@query(f"WITH {_TOKENS} SELECT doc_id, len FROM len")
def idx_doclen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).lengths.select("doc_id", F.col("len_0").cast("bigint").alias("len"))


@query(f"WITH {_part_tokens()} SELECT f, round(mean, 6) AS mean, n FROM st")
def idx_avglen(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, means = part_index(spark, sf_dir).stats
    return spark.createDataFrame([(i, round(m, 6), n) for i, m in enumerate(means)], "f int, mean double, n bigint")


@query("SELECT * FROM (VALUES ('body', 1.0::DOUBLE, 'text'), ('lang', 0.0, 'enum'), ('source', 0.0, 'enum'), ('quality', 0.0, 'enum'), ('n_chars', 0.0, 'i64')) t(field, weight, storage)")
def idx_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that a stored index says it was made with, read from nothing but its folder."""
    folder = fresh(spark, "described")
    build_index(documents(spark, sf_dir), DOCUMENTS).write(folder)
    fields = read_index(spark, folder).config.fields
    return spark.createDataFrame([(f.name, f.weight, f.storage[0]) for f in fields], "field string, weight double, storage string")


@query(f"WITH {_TOKENS} SELECT term, df, round({_idf('n', 'df')}, 6) AS idf FROM dict, st")
def idx_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = document_index(spark, sf_dir)
    n = F.lit(float(index.stats[0]))
    return index.dictionary.select("term", "df", F.round(F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


# Retrieval

_register("bm25_term", "the ", _scored(_node((_term("the"), ""))))
_register("bm25_or", "the and ention ", _scored(_node((_term("the"), ""), (_term("and"), ""), (_term("ention"), ""))))
_register("bool_and", "+the +of ", _scored(_node((_term("the"), "+"), (_term("of"), "+"))))
_register("bool_and_optional", "+the of en ", _scored(_node((_term("the"), "+"), (_term("of"), ""), (_term("en"), ""))))
_register("bool_not", "the -and ", _scored(_node((_term("the"), ""), (_term("and"), "-"))))
_register("bool_not_only", "-the -and ", _scored("SELECT doc_id, 0.0 AS score FROM documents WHERE false"))
_register("bool_inverted", "~the ", _scored(_node((_others(_term("the")), ""))))
_register("bool_inverted_and", "+~the en ", _scored(_node((_others(_term("the")), "+"), (_term("en"), ""))))
_register("bool_group", "+(the of) +(en la) ", _scored(_node((_node((_term("the"), ""), (_term("of"), "")), "+"), (_node((_term("en"), ""), (_term("la"), "")), "+"))))
_register("bool_mixed", "+the -(of and) (en ~la) ", _scored(_node((_term("the"), "+"), (_node((_term("of"), ""), (_term("and"), "")), "-"), (_node((_term("en"), ""), (_others(_term("la")), "")), ""))))
_register("bool_unknown_term", "the qqqqqqqqqqqqqqqqqq ", _scored(_node((_term("the"), ""), ("SELECT doc_id, 0.0 AS score FROM documents WHERE false", ""))))
_register("phrase2", '"the and"', _scored(_node((_phrase("the", "and"), ""))))
_register("phrase3", '"of the and"', _scored(_node((_phrase("of", "the", "and"), ""))))
_register("phrase_repeated", '"the the"', _scored(_node((_phrase("the", "the"), ""))))
_register("phrase_single", '"the"', _scored(_node((_node((_term("the"), "+")), ""))))
_register("phrase_and_term", '+"of the" -la to ', _scored(_node((_phrase("of", "the"), "+"), (_term("la"), "-"), (_term("to"), ""))))
_register("phrase_inverted", '~"the and"', _scored(_node((_others(_phrase("the", "and")), ""))))

_PARTS_SQL = _part_tokens()
_register("bm25_multifield", "small gear ", _scored(_node((_part_term("small"), ""), (_part_term("gear"), "")), _PARTS_SQL), part_index)


def _in_field(term: str, f: int) -> str:
    return f"SELECT * FROM ({_part_term(term)}) WHERE doc_id IN (SELECT doc_id FROM post WHERE term = {sql_text(term)} AND f = {f})"


_register("field_restrict", "p_type:small ring ", _scored(_node((_in_field("small", 1), ""), (_part_term("ring"), "")), _PARTS_SQL), part_index)
_register("field_inverted", "~p_type:small ", _scored(_node((_others(_in_field("small", 1), "SELECT p_partkey AS doc_id FROM part", "(SELECT n FROM n)"), "")), _PARTS_SQL), part_index)
_register("field_group", "+p_name:(small large) ", _scored(_node((f"SELECT * FROM ({_node((_part_term('small'), ''), (_part_term('large'), ''))}) WHERE doc_id IN (SELECT doc_id FROM post WHERE term IN ('small', 'large') AND f = 0)", "+")), _PARTS_SQL), part_index)


def _part_phrase(first: str, second: str, f: int) -> str:
    held = f"SELECT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = {sql_text(first)} AND b.term = {sql_text(second)} AND a.f = {f}"
    return f"SELECT doc_id, sum(score) * {1 + 3.5 / 5!r} AS score FROM ({_part_term(first)} UNION ALL {_part_term(second)}) WHERE doc_id IN ({held}) GROUP BY doc_id"


_register("field_phrase", 'p_name:"small ring" economy ', _scored(_node((_part_phrase("small", "ring", 0), ""), (_part_term("economy"), "")), _PARTS_SQL), part_index)

_NEAR = SearchOptions(max_auto_suffix=0, max_suffix=0, proximity=True)


def _near_sql(node: str, *children: tuple[str, ...]) -> str:
    """node's scores with the factor of the best window of its children, each a child's words.

    A window is a run of places at which later and later children stand: of all that begin a run, those of most children,
    and of these the narrowest.
    """
    t = len(children)
    least = max(2, -(-t // 2))
    child = " ".join(f"WHEN {sql_text(w)} THEN {i}" for i, words in enumerate(children) for w in words)
    words = ", ".join(sql_text(w) for ws in children for w in ws)
    return (
        f"SELECT s.doc_id, score * coalesce(factor, 1) AS score FROM ({node}) s LEFT JOIN (SELECT doc_id, CASE WHEN wide <= 200 AND wide * (1 + 4 * missed) <= 200 THEN 1 + {2.5 + 0.5 * t} / (4.0 + wide * (1 + 4 * missed)) ELSE 1 END AS factor FROM ("
        f"SELECT doc_id, {t} - k AS missed, pos - start AS wide, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, pos - start) AS best FROM ("
        f"SELECT doc_id, pos, row_number() OVER run AS k, min(pos) OVER (PARTITION BY doc_id, no) AS start FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM ("
        f"SELECT doc_id, pos, c, CASE WHEN c > lag(c) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM (SELECT doc_id, pos, CASE term {child} END AS c FROM tok WHERE term IN ({words})))) "
        f"WINDOW run AS (PARTITION BY doc_id, no ORDER BY pos)) WHERE k >= {least}) WHERE best = 1) f ON s.doc_id = f.doc_id"
    )


_register("proximity", "of the and ", _scored(_near_sql(_node(*((_term(w), "") for w in ("of", "the", "and"))), ("of",), ("the",), ("and",))), options=_NEAR)
_of_to = _near_sql(_node((_term("of"), ""), (_term("to"), "")), ("of",), ("to",))
_register("proximity_group", "+(of to) +the ", _scored(_near_sql(_node((_of_to, "+"), (_term("the"), "+")), ("of", "to"), ("the",))), options=_NEAR)
_register("escaped", r"the \-and ", _scored(_node((_term("the"), ""), (_term("and"), ""))))


# The dictionary


@query(f"WITH {_TOKENS} SELECT term, df FROM dict WHERE starts_with(term, 'ent') AND term != 'ent'")
def dict_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = document_index(spark, sf_dir)
    return prefixed(index.dictionary, "ent", index.frequencies(["ent"]).get("ent"), index.analyzer.stop_words)


def _prefix_sql(prefix: str, n: int) -> str:
    stops = ", ".join(map(sql_text, STOP_WORDS))
    return f"SELECT term, df FROM dict WHERE starts_with(term, '{prefix}') AND term != '{prefix}' ORDER BY term IN ({stops}), abs(df - coalesce((SELECT df FROM dict WHERE term = '{prefix}'), 4294967295)), term LIMIT {n}"


@query(f"WITH {_TOKENS} SELECT term, df FROM ({_prefix_sql('th', 5)})")
def dict_prefix_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best longer terms: a report, as expansion asks for it."""
    index = document_index(spark, sf_dir)
    return prefixed(index.dictionary, "th", index.frequencies(["th"]).get("th"), index.analyzer.stop_words).limit(5)


def _expanded_sql(prefix: str, n: int, weight: str) -> str:
    """The score of a group of a term and its n best longer terms."""
    one = "0.7 * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)))"
    rows = f"SELECT doc_id, {one} * {_idf('n', 'df')} * w AS score FROM post JOIN terms USING (term) JOIN len USING (doc_id), st"
    terms = f"terms AS (SELECT term, df, {weight} AS w FROM longer UNION ALL SELECT term, df, 1.0 FROM dict WHERE term = '{prefix}')"
    group = f"SELECT doc_id, sum(score) * (count(*) / (1.0 + (SELECT count(*) FROM longer))) ** 2 AS score FROM ({rows}) GROUP BY doc_id"
    return f"WITH {_TOKENS}, longer AS ({_prefix_sql(prefix, n)}), {terms} SELECT doc_id, round(score, 6) AS score FROM ({group})"


_register("wildcard", "ent* ", _expanded_sql("ent", 5, "1.0"), options=SearchOptions(max_auto_suffix=0, proximity=False))
_register("auto_suffix", "ent", _expanded_sql("ent", 3, "3.0 / length(term) * 0.5 / (SELECT count(*) FROM longer)"), options=SearchOptions(proximity=False))
_NONE = "SELECT doc_id, 0.0 AS score FROM documents WHERE false"
_register("spell_skipped", "the entioon* ", _scored(_node((_term("the"), ""), (_NONE, ""))), options=SearchOptions(max_auto_suffix=0, proximity=False))


def _used_sql() -> str:
    """A term, and an unfinished word whose longer terms would include it: it isn't searched twice."""
    one = "0.7 * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)))"
    rows = f"SELECT doc_id, {one} * {_idf('n', 'df')} * w AS score FROM post JOIN terms USING (term) JOIN len USING (doc_id), st"
    terms = "used AS (SELECT term FROM longer WHERE k = 1), terms AS (SELECT term, df, 3.0 / length(term) * 0.5 / (SELECT count(*) FROM longer) AS w FROM longer WHERE k > 1 UNION ALL SELECT term, df, 1.0 FROM dict WHERE term = 'ent')"
    group = f"SELECT doc_id, sum(score) * (count(*) / (0.0 + (SELECT count(*) FROM longer))) ** 2 AS score FROM ({rows}) GROUP BY doc_id"
    ordered = _prefix_sql("ent", 3).replace("SELECT term, df", "SELECT term, df, row_number() OVER (" + "ORDER BY " + _prefix_sql("ent", 3).split("ORDER BY ", 1)[1].split(" LIMIT")[0] + ") AS k")
    return f"WITH {_TOKENS}, longer AS ({ordered}), {terms} SELECT doc_id, round(score, 6) AS score FROM ({_node((_term('X').replace("'X'", '(SELECT term FROM used)'), ''), (group, ''))})"


@query(_used_sql())
def auto_suffix_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = document_index(spark, sf_dir)
    used = prefixed(index.dictionary, "ent", index.frequencies(["ent"]).get("ent"), index.analyzer.stop_words).first()["term"]
    return _rounded(search(index, f"{used} ent", SearchOptions(proximity=False)).matches.select("doc_id", "score"))


_WORDS = ("thhe", "entioon", "quedd", "lichhen", "zzzzzzzzz")


@query(
    f"WITH {_TOKENS}, w(word) AS (VALUES {', '.join(f'({sql_text(x)})' for x in _WORDS)}), near AS (SELECT word, term, df, levenshtein(term, word) AS distance, CASE WHEN length(word) <= 4 THEN 1 WHEN length(word) <= 8 THEN 2 ELSE 3 END AS most FROM dict, w) "
    "SELECT word, term, df, distance FROM near WHERE distance <= most QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, df DESC, term) = 1"
)
def spell_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best correction of each of some misspelled words."""
    d = document_index(spark, sf_dir).dictionary
    found = [corrections(d, w).limit(1).select(F.lit(w).alias("word"), "term", "df", F.col("distance").cast("bigint").alias("distance")) for w in _WORDS]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


_FIXED = "SELECT term FROM dict WHERE levenshtein(term, 'entioon') <= 2 ORDER BY levenshtein(term, 'entioon'), df DESC, term LIMIT 1"
_register("spell_query", "entioon ", _scored(_node((_term("X").replace("'X'", f"({_FIXED})"), ""))))


# Facets, sorting, paging

_QUALITY = "(SELECT doc_id, max(quality)::VARCHAR AS quality FROM labels GROUP BY doc_id)"
_THE = _node((_term("the"), ""))


def _faceted(where: str) -> str:
    return f"WITH {_TOKENS} SELECT doc_id, round(score, 6) AS score FROM ({_THE}) JOIN documents USING (doc_id) LEFT JOIN {_QUALITY} USING (doc_id) WHERE {where}"


def _facet(**kw: object) -> SearchOptions:
    return SearchOptions(max_auto_suffix=0, max_suffix=0, proximity=False, **kw)


_register("facet_enum", "the ", _faceted("lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3')"), options=_facet(enums={"lang": ["en", "fr"], "source": ["src1", "src2", "src3"]}))
_register("facet_enum_null", "the ", _faceted("quality IS NULL OR quality = '1'"), options=_facet(enums={"quality": [None, "1"]}))
_register("facet_range", "the ", _faceted("n_chars >= 1000 AND n_chars <= 5000"), options=_facet(ranges={"n_chars": (1000, 5000)}))
_register("facet_both", "the ", _faceted("n_chars >= 2000 AND lang = 'en'"), options=_facet(ranges={"n_chars": (2000, None)}, enums={"lang": ["en"]}))


@query("SELECT DISTINCT source AS value FROM documents WHERE source IS NOT NULL")
def facet_values_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_values(document_index(spark, sf_dir), "source")


EVENTS = IndexConfig(fields=(FieldConfig("user", 1.0), FieldConfig("k", storage=("enum",)), FieldConfig("level", storage=("i64",), default=-1), FieldConfig("ts", storage=("i64",), parse="datetime")), buckets=4)


def event_index(spark: SparkSession, sf_dir: str) -> Index:
    """Events as documents: zones from their JSON, twice, the first of which is blank in some, and the time from a column."""

    def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = json_column(table(spark, sf_dir, "events"), "props", {"k": "k"})
        more = F.array(*[F.struct(F.lit(f).alias("field"), t.cast("string").alias("text"), F.lit(1).alias("separation")) for f, t in (("k", F.lit(" ")), ("level", F.when(F.col("user_id") % 3 > 0, F.col("user_id"))), ("level", F.lit(7)), ("user", F.col("event_type")))])
        zones = F.filter(F.concat(F.slice(more, 1, 1), "zones", F.slice(more, 2, 9)), lambda z: z["text"].isNotNull())
        return rows.select(F.col("event_id").alias("doc_id"), zones.alias("zones"), F.date_format("ts", "yyyy MMM dd HH:mm Z").alias("ts"))

    return _index(spark, sf_dir, "events", collection, EVENTS)


@query("SELECT event_id AS doc_id, json_extract_string(props, '$.k') AS k, CASE WHEN user_id % 3 > 0 THEN user_id ELSE 7 END AS level FROM events")
def facet_from_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first value of an enum and of a number that come from zones; blank ones don't count."""
    return event_index(spark, sf_dir).docs.select("doc_id", "k", "level")


@query("SELECT event_id AS doc_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'")
def facet_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from a date input to another, as seconds."""
    docs = event_index(spark, sf_dir).docs
    return docs.where(facet_filters(docs, SearchOptions(ranges={"ts": days("2024-01-05", "2024-01-12")}))).select("doc_id")


def _sorted(order: str, first: int, upto: int, rank: bool = False) -> str:
    ranked = f"SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY {order}) AS rank FROM ({_THE}) JOIN documents USING (doc_id)"
    return f"WITH {_TOKENS} SELECT doc_id, score{', rank' if rank else ''} FROM ({ranked}) WHERE rank > {first} AND rank <= {upto}"


_register("sort_num_desc", "the ", _sorted("n_chars DESC, round(score, 9) DESC, doc_id", 0, 50), options=_facet(sort="n_chars"), shape=lambda q: _rounded(q.top(50).select("doc_id", "score")))
_register("sort_num_asc", "the ", _sorted("n_chars, round(score, 9) DESC, doc_id", 0, 50), options=_facet(sort="n_chars", ascending=True), shape=lambda q: _rounded(q.top(50).select("doc_id", "score")))
_register("topk", "the ", _sorted("round(score, 9) DESC, doc_id", 0, 10), shape=lambda q: _rounded(q.top(10).select("doc_id", "score")))
_register("page2", "the ", _sorted("round(score, 9) DESC, doc_id", 10, 20, True), shape=lambda q: _rounded(q.page(1, 10).select("doc_id", "score", F.col("rank").cast("bigint").alias("rank"))))
_register("result_limit", "the ", _sorted("round(score, 9) DESC, doc_id", 0, 7), options=_facet(result_limit=7), shape=lambda q: _rounded(q.top(100).select("doc_id", "score")))
_register("results_total", "the ", f"WITH {_TOKENS} SELECT count(*) AS results_total FROM ({_THE})", shape=lambda q: q.total())


# Loading


@query("SELECT event_id, (CASE WHEN value >= 0 THEN floor(value + 0.5) ELSE ceil(value - 0.5) END)::BIGINT AS v FROM events")
def num_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", number(F.col("value").cast("string"), FieldConfig("v", storage=("i64",), parse="round")).alias("v"))


@query("SELECT event_id, floor(epoch(ts) / 60)::BIGINT * 60 AS v FROM events")
def num_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format(F.col("ts"), "yyyy MMM dd HH:mm Z")
    return table(spark, sf_dir, "events").select("event_id", number(text, FieldConfig("v", storage=("i64",), parse="datetime")).alias("v"))


@query(
    "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS h1 FROM pages"
)
def src_html_title_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and first heading as markup has them, before entities are decoded."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.nullif(F.regexp_extract(html, "<h1>([^<]*)</h1>", 1), F.lit("")).alias("h1"))


@query()
def src_html_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All zones of all pages; parsing markup is beyond SQL, and the tests hold it against hand-made pages."""
    zones = html_zones(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path="url")
    return zones.select("page_id", F.posexplode("zones").alias("zone_no", "z")).select("page_id", "zone_no", "z.field", "z.text", "z.separation")


@query("SELECT event_id, field, text FROM (SELECT event_id, unnest(json_keys(props)) AS field, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || field) AS text) WHERE text IS NOT NULL")
def src_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a column of JSON objects as zones, for all keys that occur."""
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    keys = sorted(r[0] for r in rows.select(F.explode(F.json_object_keys("props"))).distinct().collect())
    zones = json_column(rows, "props", {k: k for k in keys})
    return zones.select("event_id", F.explode("zones").alias("z")).select("event_id", "z.field", "z.text")


@query("SELECT p_partkey, field, text FROM (SELECT p_partkey, unnest([{'field': 'title', 'text': p_name}, {'field': 'body', 'text': p_type}], recursive := true) FROM part) WHERE text IS NOT NULL")
def src_csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as zones by header name and by number."""
    rows = csv_zones(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), {"p_name": "title", 2: "body"})
    return rows.select("p_partkey", F.explode("zones").alias("z")).select("p_partkey", "z.field", "z.text")


_ODD = "'x' || chr(8232) || chr(133) || chr(12) || 'y, \"q\"' || chr(10) || '#z'"


@query(f"SELECT p_partkey::VARCHAR AS title, p_name || {_ODD} AS body FROM part WHERE p_partkey % 2 = 0")
def src_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of CSV files with quoted line ends, marks and rare separators, as they were before they were written."""
    folder = fresh(spark, "csv")
    odd = F.lit('x\u2028\x85\x0cy, "q"\n#z')
    rows = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.lit("-").alias("left out"), F.concat("p_name", odd).alias("body"), F.col("p_partkey").cast("string").alias("title"))
    rows.write.option("header", "true").option("quoteAll", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(folder)
    docs = load_folder(spark, folder, Loaders(csv_options={"header": "true", "comment": "#"}))
    return docs.select(F.filter("zones", lambda z: z["field"] == "title")[0]["text"].alias("title"), F.filter("zones", lambda z: z["field"] == "body")[0]["text"].alias("body"))


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, int]]:
    """The nations, 25 at any scale, to write small files of."""
    return [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


@query(
    "SELECT 'n/' || n_nationkey || '.txt' AS path, 0 AS doc_no, '_relative_fp=n/' || n_nationkey || '.txt;body=' || n_name AS zones FROM nation WHERE n_regionkey != 2 "
    "UNION ALL SELECT 'all.json', n_nationkey, '_relative_fp=all.json#' || n_nationkey || ';title=' || n_name || ';body=' || n_regionkey FROM nation"
)
def src_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of text files, a JSON array and files that no loader reads, some excluded though they are included."""
    folder, rows = fresh(spark, "folder"), _nations(spark, sf_dir)
    for k, name, region in rows:
        put(spark, f"{folder}/{'skipped' if region == 2 else 'n'}/{k}.txt", name)
    put(spark, f"{folder}/all.json", json.dumps([{"body": r, "title": n} for _, n, r in rows]))
    put(spark, f"{folder}/n/other.bin", "x")
    put(spark, f"{folder}/deep/er/more.TXT", "not included")
    docs = load_folder(spark, folder, include=["n/*", "*.json", "skipped/*"], exclude=["skipped/*"])
    return docs.select("path", "doc_no", F.array_join(F.transform("zones", lambda z: F.concat(z["field"], F.lit("="), z["text"])), ";").alias("zones"))


@query("SELECT 'n' || n_nationkey || '.pdf' AS path, n_name || chr(10) || '(' || n_regionkey || ')' AS body FROM nation")
def src_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small PDF a nation."""
    folder = fresh(spark, "pdf")
    for k, name, region in _nations(spark, sf_dir):
        shown = f"BT /F1 12 Tf ({name}) Tj T* (\\({region}\\)) Tj ET"
        put(spark, f"{folder}/n{k}.pdf", f"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n<< /Length {len(shown)} >>\nstream\n{shown}\nendstream\nendobj\n")
    docs = load_folder(spark, folder)
    return docs.select("path", F.filter("zones", lambda z: z["field"] == "body")[0]["text"].alias("body"))


_WITH_LINKS = "nat AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)"


@query(
    f"WITH {_WITH_LINKS} SELECT 'r' || r_regionkey || '.json' AS path, 0 AS doc_no, r_name || coalesce((SELECT '|' || string_agg(n_name, '|' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey), '') || '|last' AS titles FROM region "
    "UNION ALL SELECT 'sub/' || n_regionkey || '.json', i, n_name || '|last' FROM nat UNION ALL SELECT 'last.json', 0, 'last'"
)
def src_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that link others, which link a last one and that itself; each stays a document of its own too."""
    folder, rows = fresh(spark, "linked"), _nations(spark, sf_dir)
    for k, name in (tuple(r) for r in table(spark, sf_dir, "region").collect()):
        put(spark, f"{folder}/r{k}.json", json.dumps({"title": name, "_add_files": f"./x/y/../.././sub/{k}.json"}))
        put(spark, f"{folder}/sub/{k}.json", json.dumps([{"title": n, "_add_files": "../last.json"} for _, n, r in rows if r == k]))
    put(spark, f"{folder}/last.json", json.dumps({"title": "last", "_add_files": "last.json"}))
    docs = load_folder(spark, folder)
    return docs.select("path", "doc_no", F.array_join(F.transform(F.filter("zones", lambda z: z["field"] == "title"), lambda z: z["text"]), "|").alias("titles"))


@query("SELECT conv_id, count(*) AS zones, string_agg(text, ' | ' ORDER BY turn) AS joined FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def src_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows as the ordered zones of one document."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    docs = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return docs.select("conv_id", F.size("t").cast("bigint").alias("zones"), F.array_join("t", " | ").alias("joined"))


# Results

_register(
    "res_kv", "the ", f"WITH {_TOKENS}, top AS (SELECT doc_id, score FROM ({_THE}) ORDER BY round(score, 9) DESC, doc_id LIMIT 10) SELECT doc_id, text AS body FROM top JOIN documents USING (doc_id)",
    shape=lambda q: results.first_values(results.stored_fields(q.top(10).select("doc_id"), q.index), "body").select("doc_id", "body"),
)
_register("res_segments", "the and", None, options=_facet(), shape=lambda q: results.segments(results.stored_fields(q.matches.select("doc_id"), q.index), [[f] for f in q.forms()], columns=("seg_no", "type", "num_terms", "window")))
_register("res_highlight", "ention the ", None, shape=lambda q: results.best_segments(results.segments(results.stored_fields(q.matches.select("doc_id"), q.index), [[f] for f in q.forms()], columns=("seg_no", "type", "chars", "num_terms", "highlight"), most=2)).select("doc_id", "highlight", "num_terms"))


@query(r"SELECT page_id, 'https://example.org/' || regexp_replace(url, '^https?://', '') || '#top' AS link FROM pages")
def res_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", results.result_link(F.lit(None).cast("string"), path, "https://example.org/", F.lit("top")).alias("link"))


_WORDS_OF = r"regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[\s_-]+', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g')"


@query(
    f"WITH w AS (SELECT page_id, array_to_string(list_transform(string_split({_WORDS_OF}, '/'), lambda p: array_to_string(list_transform(string_split(p, ' '), lambda w: upper(w[1]) || w[2:]), ' ')), ' » ') AS whole FROM pages), "
    r"e AS (SELECT page_id, whole, upper(regexp_extract(whole, '([^.]*)$', 1)) AS ext FROM w) "
    r"SELECT page_id, CASE WHEN NOT contains(whole, '.') THEN '.' || upper(whole) ELSE regexp_replace(whole, '\.[^.]*$', '') || CASE ext WHEN 'HTML' THEN '' WHEN 'PDF' THEN ' (PDF)' ELSE '.' || ext END END AS title FROM e"
)
def res_breadcrumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", results.breadcrumb(F.regexp_replace("url", "^https?://[^/]*/", "")).alias("title"))


# Maintenance


_LIVE = _TOKENS.replace("FROM documents d", "FROM live d").replace("AS t FROM documents", "AS t FROM live")


@query(f"WITH live AS (SELECT * FROM documents WHERE doc_id % 3 != 0), {_LIVE} SELECT doc_id, round(score, 6) AS score FROM ({_THE})")
def inc_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search after a third of all documents were deleted."""
    folder = fresh(spark, "maintained")
    incremental.create(folder, documents(spark, sf_dir), DOCUMENTS)
    incremental.delete(folder, table(spark, sf_dir, "documents").where("doc_id % 3 = 0"), DOCUMENTS, 1)
    return _rounded(search(incremental.read(spark, folder, DOCUMENTS), "the ", PLAIN).matches.select("doc_id", "score"))


@query(f"WITH live AS (SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN text ELSE 'the ' || text END AS text) FROM documents), {_LIVE} SELECT doc_id, round(score, 6) AS score FROM ({_THE})")
def inc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search after every other document was changed, which must equal one over a new index."""
    folder = fresh(spark, "maintained")
    incremental.create(folder, documents(spark, sf_dir), DOCUMENTS)
    # the texts are changed where they are, so that they are joined with labels alone, and not at all where postings are made
    the = lambda z: z.withField("text", F.concat(F.lit("the "), z["text"]))
    rows = documents(spark, sf_dir).where("doc_id % 2 != 0").withColumn("zones", F.transform("zones", the))
    incremental.append(folder, rows, DOCUMENTS, 1)
    return _rounded(search(incremental.read(spark, folder, DOCUMENTS), "the ", PLAIN).matches.select("doc_id", "score"))


@query("SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 2 = 0 AND text IS NOT NULL THEN 'changed' ELSE 'same' END AS change FROM documents")
def inc_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("t"))
    was = docs.where("doc_id % 5 != 0").select("path", F.encode("t", "UTF-8").alias("content"))
    now = docs.where("doc_id % 7 != 0 OR doc_id % 5 = 0").select("path", F.encode(F.when(F.col("doc_id") % 2 == 0, F.concat("t", F.lit("!"))).otherwise(F.col("t")), "UTF-8").alias("content"))
    return incremental.changes(incremental.fingerprints(was), incremental.fingerprints(now))


@query(
    "SELECT 'n' || n_nationkey || '.txt' AS path, n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' again' ELSE '' END AS body FROM nation WHERE n_nationkey % 5 != 0 "
    "UNION ALL SELECT 'main.json', 'main linked anew' UNION ALL SELECT 'r' || r_regionkey || '.txt', r_name FROM region UNION ALL SELECT 'late.txt', 'linked anew'"
)
def inc_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of a folder after files were added, changed and deleted, and one that a link had missed has come."""
    source, folder, rows = fresh(spark, "source"), fresh(spark, "maintained"), _nations(spark, sf_dir)
    config = IndexConfig(fields=(FieldConfig("body", 1.0), FieldConfig("_relative_fp")), buckets=4)
    for k, name, _ in rows:
        put(spark, f"{source}/n{k}.txt", name)
    put(spark, f"{source}/main.json", json.dumps({"body": "main", "_add_files": "late.txt"}))
    incremental.update_folder(spark, source, folder, config)
    for k, name, _ in rows:
        if k % 5 == 0:
            remove(spark, f"{source}/n{k}.txt")
        elif k % 3 == 0:
            put(spark, f"{source}/n{k}.txt", f"{name} again")
    for k, name in (tuple(r) for r in table(spark, sf_dir, "region").collect()):
        put(spark, f"{source}/r{k}.txt", name)
    put(spark, f"{source}/late.txt", "linked anew")
    for _ in range(2):  # the second one finds nothing to do
        incremental.update_folder(spark, source, folder, config)
    found = search(incremental.read(spark, folder, config), "~zzzzzzzzzz ", PLAIN)
    texts = results.stored_fields(found.matches.select("doc_id"), found.index)
    of = lambda name: F.filter("texts", lambda x: x["field"] == name)
    return texts.select(of("_relative_fp")[0]["text"].alias("path"), F.array_join(F.transform(of("body"), lambda x: x["text"]), " ").alias("body"))


FLAGSHIP = "bm25_or"
