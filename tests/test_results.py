"""Segments, highlights, titles, maintenance and the stream."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from sondeur.config import FieldConfig, IndexConfig, SearchOptions
from sondeur.operators import incremental, results
from sondeur.operators.index import build_index, one_zone
from sondeur.operators.search import search
from sondeur.sources.files import load_folder, number_documents
from sondeur.storage import remove
from sondeur.streaming.maintain import maintain

TEXTS = [("title", "T"), ("body", "intro apple"), ("body", "  "), ("body", "more"), ("headingLink", "h"), ("heading", "Apple pie"), ("body", "a pear and an apple"), ("heading", "Bare"), ("link", "x")]


def test_segments():
    terms = results.patterns([["apple"], ["pear"]])
    got = [(s["type"], s["text"], s["heading"], s["heading_link"], s["num_terms"]) for s in results.document_segments(TEXTS, terms, ("body",))]
    assert got == [
        ("content", "intro apple ... more", None, None, 1),
        ("heading", "Apple pie", None, "h", 1),
        ("heading-content", "a pear and an apple", "Apple pie", "h", 3),
        ("heading", "Bare", None, None, 0),
    ]


def test_closest_window():
    terms = results.patterns([["a"], ["b"]])
    assert results.closest("a x x x b x a b", terms) == [(12, 1), (14, 1)]
    assert results.closest("abc _a ab", terms) == [(5, 1)] and results.closest("none", terms) == []
    assert results.closest("walking", results.patterns([["walk"]], stemmed=True)) == [(0, 7)] and results.closest("walking", results.patterns([["walk"]])) == []


def _closest_by_hand(text, terms):
    found = [[(m.start(2), len(m[2]) + len(m[3])) for m in p.finditer(text)] for p in terms]
    found = [f for f in found if f]
    best = None

    def go(k, chosen):
        nonlocal best
        if k == len(found):
            wide = max(p for p, _ in chosen) - min(p for p, _ in chosen)
            best = wide if best is None else min(best, wide)
            return
        for x in found[k]:
            go(k + 1, [*chosen, x])

    if found:
        go(0, [])
    return best


def test_closest_window_is_the_narrowest():
    rng = random.Random(1)
    terms = results.patterns([["a"], ["b"], ["c"]])
    for _ in range(200):
        text = " ".join(rng.choice("abcxyz") for _ in range(12))
        window = results.closest(text, terms)
        assert (max(p for p, _ in window) - min(p for p, _ in window) if window else None) == _closest_by_hand(text, terms)


def test_highlight():
    terms = results.patterns([["pear"], ["apple"]])
    mark = lambda t: results.highlight(t, results.closest(t, terms))
    assert mark("a pear & an apple") == "a <mark>pear</mark> &amp; an <mark>apple</mark> ... "
    assert mark("nothing here") == "nothing here ... "
    long = "word " * 30 + "apple " + "tail " * 30
    out = mark(long)
    assert out.startswith(" ... ") and "<mark>apple</mark>" in out and len(out) < 120
    assert mark("x " * 100).endswith(" ... ") and len(mark("x " * 100)) <= 90


def test_best_segments(spark):
    rows = spark.createDataFrame([(1, 0, "content", "aa", 1), (1, 1, "heading-content", "b", 2), (1, 2, "heading-content", "bbb", 2), (1, 3, "heading-content", "bb", 2), (2, 0, "content", "x", 0)], "doc_id int, seg_no int, type string, text string, num_terms int")
    assert [(r["doc_id"], r["seg_no"]) for r in results.best_segments(rows).orderBy("doc_id", "place").collect()] == [(1, 2), (1, 3), (2, 0)]


def test_titles_and_links(spark):
    rows = spark.createDataFrame([("my_docs/someFile-name.html",), ("a/b.pdf",), ("x.txt",), ("noext",)], "p string")
    assert [r[0] for r in rows.select(results.breadcrumb(F.col("p"))).collect()] == ["My Docs » Some File Name", "A » B (PDF)", "X.TXT", ".NOEXT"]
    link = results.result_link(F.lit(None).cast("string"), F.col("p"), "http://h/", F.lit("top"))
    assert rows.select(link).first()[0] == "http://h/my_docs/someFile-name.html#top" and rows.select(results.title(F.lit("T"), F.col("p"))).first()[0] == "T"


CONFIG = IndexConfig(fields=(FieldConfig("body", 1.0), FieldConfig("kind", storage=("enum",))))


def collection(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, kind string").select("doc_id", one_zone("body", F.col("text")).alias("zones"), "kind")


def scores(index, text="apple pear "):
    return {r["doc_id"]: round(r["score"], 9) for r in search(index, text, SearchOptions(max_suffix=0)).matches.collect()}


def test_maintained_equals_rebuilt(spark, tmp_path):
    folder = f"{tmp_path}/kept"
    first = [(1, "apple pie", "x"), (2, "pear tart", "y"), (3, "apple pear", None), (4, "none", "x")]
    assert incremental.needs_rebuild(spark, folder, CONFIG)
    incremental.create(folder, collection(spark, first), CONFIG)
    assert not incremental.needs_rebuild(spark, folder, CONFIG)
    assert incremental.needs_rebuild(spark, folder, IndexConfig(fields=CONFIG.fields, max_term_len=9)) and incremental.needs_rebuild(spark, folder, CONFIG, by_content=False)
    second = [(2, "pear pear apple", "z"), (5, "apple", "x")]
    for _ in range(2):  # a segment that is written again changes nothing
        incremental.append(folder, collection(spark, second), CONFIG, 1)
    for _ in range(2):
        incremental.delete(folder, spark.createDataFrame([(1,)], "doc_id bigint"), CONFIG, 2)
    now = collection(spark, [first[2], first[3], *second])
    want = build_index(now, CONFIG)
    kept = incremental.read(spark, folder, CONFIG)
    assert scores(kept) == scores(want) and kept.stats == want.stats
    assert {tuple(r) for r in kept.dictionary.collect()} == {tuple(r) for r in want.dictionary.collect()}
    incremental.append(folder, collection(spark, [(1, "apple again", "x")]), CONFIG, 3)  # what was deleted may come back
    assert 1 in scores(incremental.read(spark, folder, CONFIG))
    incremental.compact(spark, folder, f"{tmp_path}/compact", CONFIG)
    assert scores(incremental.read(spark, f"{tmp_path}/compact", CONFIG)) == scores(incremental.read(spark, folder, CONFIG))


def test_an_update_is_seen_whole_or_not_at_all(spark, tmp_path):
    folder = f"{tmp_path}/kept"
    incremental.create(folder, collection(spark, [(1, "apple", "x"), (2, "pear", "y")]), CONFIG)
    before = scores(incremental.read(spark, folder, CONFIG))
    incremental.append(folder, collection(spark, [(1, "pear apple pear", "x"), (3, "pear", "x")]), CONFIG, 1)
    after = scores(incremental.read(spark, folder, CONFIG))
    remove(spark, f"{folder}/commits/segment=1")  # as if it had died before its commit
    assert scores(incremental.read(spark, folder, CONFIG)) == before != after
    incremental.append(folder, collection(spark, [(1, "pear apple pear", "x"), (3, "pear", "x")]), CONFIG, 1)
    index = incremental.read(spark, folder, CONFIG)
    assert scores(index) == after and incremental.committed(spark, folder) == [0, 1]
    plan = index.scan(["pear"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_folder_and_its_index(spark, tmp_path):
    source, folder = tmp_path / "source", f"{tmp_path}/index"
    (source / "sub").mkdir(parents=True)
    config = IndexConfig(fields=(FieldConfig("body", 1.0), FieldConfig("title", 2.0), FieldConfig("_relative_fp")))
    put = lambda name, text: (source / name).write_text(text)
    put("a.txt", "apple")
    put("b.csv", "title,body\nx,apple\ny,pear\n")
    put("c.json", '{"body": "plum", "_add_files": "sub/later.txt"}')
    put("other.bin", "x")

    def again():
        counts = incremental.update_folder(spark, str(source), folder, config)
        index = incremental.read(spark, folder, config)
        want = build_index(number_documents(load_folder(spark, str(source))).select("doc_id", "zones"), config)
        texts = lambda i: sorted(str([tuple(x) for x in r["texts"]]) for r in i.docs.collect())
        assert texts(index) == texts(want) and index.stats == want.stats
        assert {tuple(r) for r in index.dictionary.collect()} == {tuple(r) for r in want.dictionary.collect()}
        found = lambda i: sorted(round(s, 9) for s in scores(i, "apple pear plum late ").values())
        assert found(index) == found(want)
        return counts

    assert again() == {"added": 4}
    assert again() == {"same": 4}
    put("a.txt", "apple apple pear")
    put("b.csv", "title,body\nx,apple\n")
    put("d.txt", "pear")
    assert again() == {"same": 2, "changed": 2, "added": 1}
    put("sub/later.txt", "late plum")  # c.json had named it before it was there
    assert again() == {"same": 4, "changed": 1, "added": 1}
    put("sub/later.txt", "later plum")
    (source / "d.txt").unlink()
    assert again() == {"same": 3, "changed": 2, "deleted": 1}
    assert incremental.committed(spark, folder) == [0, 1, 2, 3]
    config = IndexConfig(fields=config.fields, max_term_len=5)  # another configuration: all is built anew
    assert again() == {"added": 5} and incremental.committed(spark, folder) == [0]


def test_a_stream_keeps_one_of_equal_versions(spark, tmp_path):
    folder, source = f"{tmp_path}/kept", f"{tmp_path}/source"
    incremental.create(folder, collection(spark, [(1, "apple", "x")]), CONFIG)
    rows = collection(spark, [(1, "pear", "x"), (1, "pear pear", "x"), (2, "apple", "x"), (2, "apple", "x")]).withColumn("version", F.lit(1))
    rows.coalesce(1).write.parquet(source)
    maintain(spark.readStream.schema(rows.schema).parquet(source), folder, CONFIG, f"{tmp_path}/checkpoint", available_now=True).awaitTermination(120)
    assert sorted(r["doc_id"] for r in incremental.read(spark, folder, CONFIG).docs.collect()) == [1, 2]


def test_changes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, hash bigint")
    new = spark.createDataFrame([("b", 1), ("c", 2), ("d", 1)], "path string, hash bigint")
    assert {tuple(r) for r in incremental.changes(old, new).collect()} == {("a", "deleted"), ("b", "same"), ("c", "changed"), ("d", "added")}
    links = spark.createDataFrame([("b", ["c"]), ("a", [])], "path string, linked array<string>")
    assert {r["path"]: r["change"] for r in incremental.changes(incremental.with_links(old, links), incremental.with_links(new, links)).collect()}["b"] == "changed"


def test_a_stream_maintains_an_index(spark, tmp_path):
    folder, source = f"{tmp_path}/kept", f"{tmp_path}/source"
    incremental.create(folder, collection(spark, [(1, "apple", "x"), (2, "pear", "x")]), CONFIG)
    schema = "doc_id bigint, zones array<struct<field:string,text:string,separation:int>>, kind string, deleted boolean, version int"
    for k, rows in enumerate([[(3, "apple pear", "x", False, 1), (3, "old", "x", False, 0), (2, None, None, True, 1)], [(1, "pear", "y", False, 2)]]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, deleted boolean, version int").select("doc_id", one_zone("body", F.col("text")).alias("zones"), "kind", "deleted", "version")
        df.coalesce(1).write.mode("append").parquet(f"{source}")
        query = maintain(spark.readStream.schema(schema).parquet(source), folder, CONFIG, f"{tmp_path}/checkpoint", available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None and k >= 0
    want = build_index(collection(spark, [(3, "apple pear", "x"), (1, "pear", "y")]), CONFIG)
    assert scores(incremental.read(spark, folder, CONFIG)) == scores(want)


class _Rows:
    """Stands for rows (doc_id, texts), and gives what would run over their batches."""

    dtypes = [("doc_id", "bigint")]

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_segments_are_held_a_few_texts_at_a_time():
    """A batch of long texts gives several batches, and of a document no more segments than are asked for."""
    texts = [[{"field": f, "text": f"{t} {i} apple " + "x " * 100_000} for f, t in (("heading", "h"), ("body", "a"), ("heading", "pear"), ("body", "pear"))] for i in range(12)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(12)), "texts": texts})
    run = results.segments(_Rows(), [["apple"], ["pear"]])
    out = list(run(iter([batch])))
    assert len(out) > 3 and sum(b.num_rows for b in out) == 48
    whole = pa.Table.from_batches(out)
    best = pa.Table.from_batches(results.segments(_Rows(), [["apple"], ["pear"]], columns=("seg_no", "chars", "num_terms"), most=2)(iter([batch])))
    assert best["doc_id"].to_pylist() == [i for i in range(12) for _ in range(2)]
    assert best["seg_no"].to_pylist() == [3, 1] * 12
    assert best["num_terms"].to_pylist() == [n for i in range(12) for n in (whole["num_terms"].to_pylist()[4 * i + 3], whole["num_terms"].to_pylist()[4 * i + 1])]
    assert set(best["chars"].to_pylist()) <= {len(t) for t in whole["text"].to_pylist()}


def test_plain_words_are_found_as_by_their_pattern():
    rng = random.Random(2)
    terms = results.patterns([["ab"], ["a"], ["B1"], ["a", "ab"]])
    for _ in range(3000):
        text = "".join(rng.choice("aAbB1_ -\n") for _ in range(rng.randrange(12)))
        for p in terms:
            assert results._matches(text, text.lower(), p) == [(m.start(2), len(m[2]) + len(m[3])) for m in p.finditer(text)], (text, p)
    assert [results._word(p.pattern) for p in terms] == ["ab", "a", "b1", None]
    assert results.closest("x THE ſ", results.patterns([["the"], ["s"]])) == [(2, 3), (6, 1)]
