"""Retrieval, scoring and the rest of the engine over small hand-made collections."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sondeur.config import DEFAULT_FIELDS, FieldConfig, IndexConfig, SearchOptions, merged_fields, preset
from sondeur.operators import proximity
from sondeur.operators.index import Index, build_index, configuration, frequencies, manifest, number, read_index, zones_of
from sondeur.operators.search import days, facet_values, search, ticked

FIELDS = (FieldConfig("title", 0.3), FieldConfig("body", 0.3), FieldConfig("heading", 0.3))
CONFIG = IndexConfig(fields=FIELDS)
TITLE, BODY = 0, 1


def postings(spark, lists, docs=10, config=CONFIG):
    """An index of hand-written postings: {term: {doc: {field: positions}}}; every field of every document has length 1."""
    rows = [(t, d, *(x for f in range(3) for x in (len(fs.get(f, [])), fs.get(f, []))), 1, 1, 1) for t, ds in lists.items() for d, fs in ds.items()]
    schema = "term string, doc_id bigint, " + ", ".join(f"tf_{f} int, pos_{f} array<int>" for f in range(3)) + ", len_0 int, len_1 int, len_2 int"
    table = spark.createDataFrame(rows, schema)
    lengths = spark.range(docs).select(F.col("id").alias("doc_id"), *[F.lit(1).alias(f"len_{f}") for f in range(3)])
    return Index(config, table, lengths.select("doc_id"), frequencies(table), lengths)


def found(index, text, **options):
    return {r["doc_id"]: r["score"] for r in search(index, text + " ", SearchOptions(max_suffix=0, **options)).matches.collect()}


@pytest.fixture(scope="module")
def alder(spark):
    return postings(
        spark,
        {
            "alder": {0: {TITLE: [1, 12, 31]}, 1: {BODY: [5]}, 3: {TITLE: [2], BODY: [40]}, 4: {BODY: [1, 2, 3, 4]}, 6: {TITLE: [7]}},
            "birch": {0: {TITLE: [11, 13, 32]}, 1: {BODY: [9]}, 2: {TITLE: [3]}, 3: {BODY: [41]}, 5: {TITLE: [1]}},
            "cedar": {0: {BODY: [60]}, 3: {BODY: [42]}, 7: {TITLE: [1], BODY: [70]}},
        },
    )


@pytest.mark.parametrize(
    ("text", "docs"),
    [
        ("alder", {0, 1, 3, 4, 6}), ("alder birch", {0, 1, 2, 3, 4, 5, 6}), ("+alder +birch", {0, 1, 3}), ("+alder birch", {0, 1, 3, 4, 6}), ("alder -birch", {4, 6}), ("-alder", set()), ("-alder -alder", set()),
        ("~alder", {2, 5, 7, 8, 9}), ("+~alder +birch", {2, 5}), ("alder -~birch", {0, 1, 3}), ("~~alder", {2, 5, 7, 8, 9}),
        ('"alder birch"', {0, 3}), ('~"alder birch"', {1, 2, 4, 5, 6, 7, 8, 9}), ('"alder alder"', {4}), ('"alder birch cedar"', {3}), ('"alder"', {0, 1, 3, 4, 6}), ('"alder unknownword birch"', {0, 3}), ('"unknownword"', set()),
        ("title:alder", {0, 3, 6}), ("body:alder", {1, 3, 4}), ("~title:alder", {1, 2, 4, 5, 7, 8, 9}), ("title:(alder birch)", {0, 2, 3, 5, 6}), ('title:"alder birch"', {0}), ("title:-alder birch", {1, 2, 5}), ("+title:alder +body:birch", {3}),
        ("(+alder +birch) cedar", {0, 1, 3, 7}), ("+(alder cedar) -(birch)", {4, 6, 7}), ("alder unknownword", {0, 1, 3, 4, 6}), ("+alder +unknownword", set()), ("", set()), ("(", set()),
    ],
)
def test_documents(alder, text, docs):
    assert set(found(alder, text)) == docs
    assert set(found(alder, text, proximity=False)) == docs


def test_worked_scores(spark):
    config = IndexConfig(fields=(FieldConfig("title", 2.0, 1.2, 0.15), FieldConfig("body", 1.0, 1.2, 0.75)))
    rows = [("t", 0, 1, [0], 3, [9, 10, 11], 1, 50), ("t", 1, 0, [], 1, [4], 1, 40), ("u", 2, 0, [], 1, [0], 1, 40)]
    table = spark.createDataFrame(rows, "term string, doc_id bigint, tf_0 int, pos_0 array<int>, tf_1 int, pos_1 array<int>, len_0 int, len_1 int")
    docs = spark.createDataFrame([(i, 2, 40) for i in range(10)], "doc_id bigint, len_0 int, len_1 int")
    index = Index(config, table, docs.select("doc_id"), frequencies(table), docs)
    assert index.stats == (10, [2.0, 40.0])
    assert math.isclose(found(index, "t")[0], 2.825677, abs_tol=1e-6)  # both fields, by the soft maximum
    body = index.postings.where("doc_id = 0").withColumns({"tf_0": F.lit(0), "pos_0": F.array().cast("array<int>")}).union(index.postings.where("doc_id != 0"))
    one = Index(IndexConfig(fields=config.fields), body, docs.select("doc_id"), frequencies(body), docs)
    assert math.isclose(found(one, "t")[0], 0.7 * 1.491525 * 1.481605, abs_tol=1e-5)
    assert math.isclose(found(one, "t zzzzzzzzzzzzz")[0], 0.7 * 1.491525 * 1.481605 / 4, abs_tol=1e-5)  # one of two terms
    assert math.isclose(found(index, "~t")[5], 0.257829, abs_tol=1e-6)


@pytest.mark.parametrize(("lists", "total", "least", "want"), [([[1], [2]], 2, 2, 1.7), ([[1], [6]], 2, 2, 1.388889), ([[5], [7]], 3, 2, 1.285714), ([[1], [500]], 2, 2, 1.0), ([[3], [1]], 2, 2, 1.0)])
def test_proximity_by_hand(lists, total, least, want):
    assert math.isclose(proximity.plain_factor(lists, total, least), want, abs_tol=1e-6)


def test_phrase_factor():
    assert math.isclose(proximity.phrase_factor(3), 1.666667, abs_tol=1e-6)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=8, unique=True).map(sorted), min_size=2, max_size=4), st.integers(0, 2)), min_size=30, max_size=30))
def test_proximity_expression_equals_plain(spark, cases):
    for total in (3, 4, 5):
        some = [(i, lists) for i, (lists, _) in enumerate(cases) if len(lists) <= total]
        least = max(2, math.ceil(total / 2))
        df = spark.createDataFrame(some, "id int, lists array<array<int>>").select("id", proximity.factor(F.col("lists"), total, least).alias("x"))
        got = {r["id"]: r["x"] for r in df.collect()}
        for i, lists in some:
            assert math.isclose(got[i], proximity.plain_factor(lists, total, least), rel_tol=1e-12)


DOCS = [
    (1, "Red apples", "The apple is red. Apples are sweet", "fruit", 10, "5"),
    (2, "Green pears", "A pear, green and sweet; not an apple", "fruit", -3, "7.5"),
    (3, "Blue sky", "The sky is blue today, and clear", None, 7, None),
    (4, "", "", "", 0, "x"),
    (5, "Straßencafé", "Über die Straße zum Café; l'été d'Été", "place", 99, "-2.5"),
]


@pytest.fixture(scope="module")
def shop(spark):
    rows = spark.createDataFrame(DOCS, "doc_id bigint, title string, body string, kind string, price bigint, stars string")
    config = IndexConfig(fields=(FieldConfig("title", 2.0, 1.2, 0.15), FieldConfig("body", 1.0), FieldConfig("kind", storage=("enum",)), FieldConfig("price", storage=("i64",)), FieldConfig("stars", storage=("i64",), parse="round", default=1)), buckets=4)
    collection = rows.select("doc_id", zones_of({"title": F.col("title"), "body": F.col("body")}).alias("zones"), "kind", "price", "stars")
    return collection, config, build_index(collection, config)


def test_facets_and_sorting(shop):
    _, _, index = shop
    run = lambda text="~zzzzzzzzzzzz", **o: [r["doc_id"] for r in search(index, text, SearchOptions(**o)).top(10).collect()]
    assert run(enums={"kind": ["fruit"]}) == [1, 2] and run(enums={"kind": [None]}) == [3, 4] and run(enums={"kind": [None, "place"]}) == [3, 4, 5] and run(enums={"kind": ["other"]}) == []
    assert run(enums={"unknown": ["x"]}) == [1, 2, 3, 4, 5]
    assert run(ranges={"price": (-3, 7)}) == [2, 3, 4] and run(ranges={"price": (None, 0)}) == [2, 4] and run(ranges={"price": (8, None)}, enums={"kind": ["fruit"]}) == [1]
    assert run(sort="price") == [5, 1, 3, 4, 2] and run(sort="price", ascending=True) == [2, 4, 3, 1, 5] and run(sort="price", result_limit=2) == [5, 1]
    assert {r["doc_id"]: r["stars"] for r in index.docs.collect()} == {1: 5, 2: 8, 3: 1, 4: 1, 5: -3}
    assert sorted(r["value"] for r in facet_values(index, "kind").collect()) == ["fruit", "place"]
    assert ticked(["a", "b"], ["a", "b"]) is None and ticked(["a", "b"], []) is None and ticked(["a", "b"], ["a"]) == ["a"]


def test_folding_and_spelling(shop):
    _, _, index = shop
    docs = lambda text: {r["doc_id"] for r in search(index, text).matches.collect()}
    assert docs("strasse ") == docs("STRAẞE ") == docs("Straße ") == {5} and docs("cafe ") == {5} and docs("lété ") == {5}
    q = search(index, "appel ")
    assert q.parts[0].corrected and q.parts[0].term in ("apple", "apples") and "appel" in q.forms()
    assert docs("app*") >= {1, 2} and docs("appl") >= {1, 2}


def test_pages_make_up_the_ranking(shop):
    _, _, index = shop
    q = search(index, "the apple sweet")
    every = [r["doc_id"] for r in q.top(100).collect()]
    paged = [r["doc_id"] for k in range(3) for r in q.page(k, 2).orderBy("rank").collect()]
    assert paged == every and q.total().first()[0] == len(every)


def test_a_stored_index_answers_alike(shop, tmp_path):
    _, _, index = shop
    stored = index.write(f"{tmp_path}/index")
    for text in ("apple", "+the -sky", '"is red"', "title:red ~blue", "sweet*"):
        a, b = ({r["doc_id"]: round(r["score"], 9) for r in search(i, text).matches.collect()} for i in (index, stored))
        assert a == b
    plan = stored.scan(["apple"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [IsNotNull(term), " in plan


def test_an_index_describes_itself(shop, spark, tmp_path):
    _, config, index = shop
    index.write(f"{tmp_path}/index")
    again = read_index(spark, f"{tmp_path}/index", remember=True)
    assert again.config == config and json.loads(manifest(config))["id"] != json.loads(manifest(config))["id"]
    with pytest.raises(ValueError):
        configuration(json.dumps(json.loads(manifest(config)) | {"version": 1}))
    with pytest.raises(FileNotFoundError):
        read_index(spark, f"{tmp_path}/nothing")
    # postings and corrections that are remembered: the last few
    for text in ("apple", "+the -sky", "sweet appel ", "red green blue ", "today clear pears "):
        assert {r["doc_id"] for r in search(again, text).matches.collect()} == {r["doc_id"] for r in search(index, text).matches.collect()}
    assert len(again.held) == 8 and list(again.corrected) == ["appel"] and not index.held
    for k in range(10):
        again.correction(f"w{k}", lambda: None)
    assert list(again.corrected) == [f"w{k}" for k in range(2, 10)]


def test_days():
    assert days("1970-01-02", "1970-01-02") == (86_400, 172_799) and days(None, None) == (None, None) and days("1969-12-31", None) == (-86_400, None)


def test_folds_and_complements_are_planned_once(shop):
    _, _, index = shop
    plan = search(index, "the apple sweet ").matches._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_identities(shop):
    _, _, index = shop
    docs = lambda text: {r["doc_id"] for r in search(index, text, SearchOptions(max_suffix=0)).matches.collect()}
    assert docs("+the +sweet ") <= docs("the sweet ") and docs("the -the ") == set() and docs("the ") | docs("~the ") == {1, 2, 3, 4, 5} and not docs("the ") & docs("~the ")


def test_numbers(spark):
    rows = spark.createDataFrame([("5", "2.5", "2001 Jan 02 03:04 +0100"), ("x", "-2.5", "1960 Jan 01 00:00 +0000"), (None, None, "?")], "a string, b string, c string")
    out = rows.select(number(F.col("a"), FieldConfig("a")), number(F.col("b"), FieldConfig("b", parse="round")), number(F.col("c"), FieldConfig("c", parse="datetime"))).collect()
    assert [tuple(r) for r in out] == [(5, 3, 978401040), (None, -3, -315619200), (None, None, None)]


def test_config():
    fields = merged_fields({"h1": None, "tag": FieldConfig("tag", storage=("enum",))}, DEFAULT_FIELDS)
    assert [f.name for f in fields] == ["title", "heading", "body", "headingLink", "_relative_fp", "link", "tag"]
    assert [f.name for f in IndexConfig(fields=fields).scored] == ["title", "heading", "body"]
    assert preset("small").buckets < preset("large").buckets


def test_without_positions(spark, shop):
    collection, config, _ = shop
    from dataclasses import replace

    index = build_index(collection, replace(config, with_positions=False))
    assert not any(c.startswith("pos") for c in index.postings.columns)
    assert {r["doc_id"] for r in search(index, '"is red" ').matches.collect()} == {1, 3}  # quotes are ordinary


def test_stop_words_and_stems(spark, shop):
    collection, config, _ = shop
    from dataclasses import replace

    index = build_index(collection, replace(config, ignore_stop_words=True, analyzer="ascii_stemmer"))
    terms = {r["term"] for r in index.dictionary.collect()}
    assert "the" not in terms and "appl" in terms and "apple" not in terms
    assert {r["doc_id"] for r in search(index, "the apples ").matches.collect()} == {1, 2}


def test_phrase_of_one_term_is_not_shuffled(alder, monkeypatch):
    """It gives what grouping its children would, in each of its uses, without an exchange."""
    from sondeur.plans.compile import Compiler

    texts = ('"alder alder"', '"alder alder alder"', 'body:"alder alder" cedar', '+("alder alder" birch) cedar', '~"alder alder"', 'title:"alder alder"')
    own = [found(alder, t) for t in texts]
    plan = search(alder, '"alder alder" ', SearchOptions(max_suffix=0)).parts[0]
    made = Compiler(alder, SearchOptions())
    made.query([plan])
    assert "Exchange" not in made.part(plan, 1.0, False)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Compiler, "_one_term", lambda self, children: False)
    for t, x in zip(texts, own, strict=True):
        assert found(alder, t) == pytest.approx(x), t
