"""Analyzers, against small vectors and against each other."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sondeur.config import FieldConfig, IndexConfig
from sondeur.functions import folding
from sondeur.functions.analysis import Analyzer, analyzer_of, register
from sondeur.functions.stemmer import STEMMERS, english, stemmer
from sondeur.operators.index import build_index, build_postings, one_zone, term_counts, term_frequencies, tokens


def config(**kw):
    return IndexConfig(fields=(FieldConfig("title", 2.0), FieldConfig("body", 1.0)), **kw)


@pytest.mark.parametrize(
    ("word", "term"),
    [("today's", "todays"), ("today’s", "todays"), ("today‛s", "todays"), ("⥄a1aa2a", "a1aa2a"), ("a1aa2a⥄⥄", "a1aa2a"), ("a1a⥄a2a", "a1a⥄a2a"), ("a1a'_a2a", "a1aa2a"), ("我", None), ("⥄", None), ("straße", "strasse"), ("ﬁne", "fine"), ("x" * 81, None)],
)
def test_terms(word, term):
    assert Analyzer(config()).term(word) == term


def test_folding():
    assert folding.fold("àÉîõüßæœøÞłı") == "aeioussaeoeothli"


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("gas", "gas"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"), ("hoping", "hope"), ("happy", "happi"), ("say", "say"),
        ("relational", "relat"), ("conditional", "condit"), ("generously", "generous"), ("communication", "communic"), ("consignment", "consign"), ("consolingly", "consol"), ("knightly", "knight"), ("skies", "sky"), ("dying", "die"), ("national", "nation"), ("adjustable", "adjust"), ("controlled", "control"), ("replacement", "replac"), ("succeed", "succeed"), ("is", "is"),
    ],
)
def test_stems(word, stem):
    assert english(word) == stem


@pytest.mark.parametrize(
    ("language", "pairs"),
    [
        ("german", "aufeinanderfolgenden aufeinanderfolg kategorischen kategor kater kat auffallend auffall auffassung auffass hauses haus ergebnisse ergebnis freundlichkeiten freundlich katzen katz aufgegebenen aufgegeb"),
        ("french", "continuellement continuel continuait continu continuation continu majestueusement majestu majestueux majestu mainmise mainmis maisons maison chevaux cheval contrainte contraint nationalement national abandonner abandon"),
        ("spanish", "cheques chequ chicas chic torneos torne chicharrones chicharron tortugas tortug rapidamente rapid nacionalidades nacional haciendo hac tornado torn comprarlo compr actividades activ"),
        ("swedish", "jaktkarlarne jaktkarl jakthundar jakthund kloka klok klokaste klok klockan klockan"),
        ("danish", "indtage indtag understreger understreg undersoger undersog hustruer hustru indtraengende indtraeng"),
        ("norwegian", "havnedistriktene havnedistrikt opningens opning havnemyndighetene havnemynd oppgaver oppgav forsvarte forsvart"),
        ("dutch", "lichamelijkheden licham lichamelijk licham lichaamsziek lichaamsziek opgingen opging opgevreten opgevret katten kat"),
    ],
)
def test_stems_of_other_languages(language, pairs):
    words = pairs.split()
    assert [stemmer(language)(w) for w in words[::2]] == words[1::2]


@pytest.mark.parametrize("language", sorted(STEMMERS))
@given(st.text("abcdefghijklmnopqrstuvwxyz", max_size=12))
def test_stems_shorten_or_keep(language, word):
    assert len(stemmer(language)(word)) <= len(word) + 1


def test_an_analyzer_of_ones_own(spark):
    class Halves(Analyzer):
        def term(self, word):
            return word[: (len(word) + 1) // 2]

    register("halves", Halves)
    rows = spark.createDataFrame([(1, "abcd efg"), (2, "abxy")], "doc_id bigint, text string").select("doc_id", one_zone("body", F.col("text")).alias("zones"))
    index = build_index(rows, config(analyzer="halves"))
    assert {r["term"]: r["df"] for r in index.dictionary.collect()} == {"ab": 2, "ef": 1}
    with pytest.raises(ValueError):
        analyzer_of(config(analyzer="unheard"))


def test_other_stemmers_are_refused():
    with pytest.raises(ValueError):
        stemmer("klingon")


def collection(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, zones array<struct<field:string,text:string,separation:int>>")


def test_positions(spark):
    zones = [("title", "One two. Three", 10), ("link", "ignored", 10), ("body", "four, five six", 3), ("body", None, 5), ("body", "seven", 0)]
    got = [(r["pos"], r["field_id"], r["term"]) for r in tokens(collection(spark, [(1, zones), (2, []), (3, None)]), config()).orderBy("pos").collect()]
    # a sentence's end takes one place, also the last one's; then the zone's separation; zones that aren't searched take none
    assert got == [(0, 0, "one"), (1, 0, "two"), (3, 0, "three"), (15, 1, "four"), (17, 1, "five"), (18, 1, "six"), (23, 1, "seven")]


def test_dropped_words_leave_no_gap(spark):
    c = config(max_term_len=5, ignore_stop_words=True)
    got = [(r["pos"], r["term"]) for r in tokens(collection(spark, [(1, [("body", "red lengthy the 我 blue", 0)])]), c).collect()]
    assert got == [(0, "red"), (1, "blue")]


def test_han(spark):
    c = config(analyzer="chinese")
    got = [r["term"] for r in tokens(collection(spark, [(1, [("body", "AB 我random我 day。書、b", 0)])]), c).orderBy("pos").collect()]
    assert got == ["ab", "我", "random", "我", "day", "书", "b"]


def test_separators_and_rare_ones(spark):
    got = [r["term"] for r in tokens(collection(spark, [(1, [("body", "a.b«c»d—e　f（g）h@i_j%k", 0)])]), config()).orderBy("pos").collect()]
    assert got == ["a", "b", "c", "d", "e", "f", "g", "h", "ij%k"]


def test_postings_are_grouped_tokens(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", F.array(F.struct(F.lit("title").alias("field"), F.col("source").alias("text"), F.lit(10).alias("separation")), F.struct(F.lit("body").alias("field"), F.col("text"), F.lit(10).alias("separation"))).alias("zones"))
    t = tokens(rows, config()).groupBy("term", "doc_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("field_id") == i, F.col("pos")))).alias(f"pos_{i}") for i in (0, 1)])
    p = build_postings(rows, config())
    assert p.select("term", "doc_id", "pos_0", "pos_1").exceptAll(t).count() == 0 and p.count() == t.count()
    assert p.where("tf_0 != size(pos_0) OR tf_1 != size(pos_1)").count() == 0
    lengths = p.groupBy("doc_id").agg(F.sum("tf_1").alias("n"), F.min("len_1").alias("a"), F.max("len_1").alias("b"))
    assert lengths.where("n != a OR n != b").count() == 0
    assert build_index(rows, config()).lengths.join(lengths, "doc_id").where("len_1 != n").count() == 0


def test_terms_are_counted_where_they_are_made(spark):
    """Counts and distinct doc_ids by term, with ids that repeat or are null; by a column, each row counts once."""
    docs = [(1, "en", "a b a"), (2, "fr", "a"), (2, "en", "a c"), (None, "en", "b d"), (3, None, "c. C"), (4, "fr", None), (None, "fr", "b")]
    for some in (docs, [d for d in docs if d[0] not in (2, None)]):
        rows = spark.createDataFrame(some, "id bigint, lang string, text string").select(F.col("id").alias("doc_id"), "lang", one_zone("body", F.col("text")).alias("zones"))
        cf, df, by = {}, {}, {}
        for i, lang, text in some:
            for w in (text or "").lower().replace(".", "").split():
                cf[w] = cf.get(w, 0) + 1
                by[lang, w] = by.get((lang, w), 0) + 1
                df.setdefault(w, set()).update({i} - {None})
        got = term_frequencies(rows, config()).collect()
        assert {r["term"]: (r["cf"], r["df"]) for r in got} == {w: (n, len(df[w])) for w, n in cf.items()} and len(got) == len(cf)
        assert {(r["lang"], r["term"]): r["cf"] for r in term_counts(rows, config(), by="lang").collect()} == by
    plan = term_frequencies(rows, config())._jdf.queryExecution().executedPlan().toString()
    assert not any("doc_id" in line for line in plan.splitlines() if "HashAggregate" in line)


def test_large_collections_are_laid_out_in_more_parts(spark, tmp_path, monkeypatch):
    """A bucket's postings are sorted in more parts where there is more to sort, and are the same."""
    from sondeur.operators import index

    docs = spark.range(200).select(F.col("id").alias("doc_id"), one_zone("body", F.concat(F.lit("a b "), F.col("id").cast("string"))).alias("zones"))
    few = config(buckets=1, spread=2)
    plain = build_index(docs, few).write(str(tmp_path / "plain"))
    monkeypatch.setattr(index, "PART_BYTES", 1 << 8)
    large = build_index(docs, few)
    assert large._spread(large.built) > 2
    large = large.write(str(tmp_path / "large"))
    files = lambda x: len(list((tmp_path / x / "postings" / "bucket=0").glob("*.parquet")))
    assert files("plain") <= 2 < files("large")
    rows = lambda x: sorted(map(str, x.postings.collect()))
    assert rows(large) == rows(plain) and large.stats == plain.stats
