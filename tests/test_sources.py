"""Loaders: pages, tables, JSON, text, linked files."""

import json
import zlib

import pytest

from sondeur.sources.files import Loaders, csv_rows, json_records, load_folder, number_documents, walk
from sondeur.sources.html import Rule, matches, page_zones
from sondeur.sources.pdf import pdf_text


def test_separating_elements():
    page = (
        "lead<ul><li>u<label>v</label>w</li><li>both</li></ul><table><tr><th>north<th>south</tr><tr><td>ea<kbd>s</kbd>t</td><td>west</th></tr></table>"
        "between<h4><em>inner</em> head</h4>after<i>wards</i>"
    )
    zones = page_zones(page)
    assert [(f, t) for f, t, _ in zones] == [("body", t) for t in ("lead", "u", "v", "w", "both", "north", "south", "ea", "s", "t", "west", "between")] + [("heading", "inner head"), ("body", "afterwards")]
    assert [s for _, _, s in zones] == [3] + [0] * 11 + [3, 3]


def test_default_rules():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><meta name="description" content="about"><style>p{}</style><script>var x="<p>";</script></head>
    <body><nav><a>skipped</a></nav><h1>Head <b>one</b></h1><p>First<p>Second<br>line<div data-search-ignore>no</div><h3 id="sec">Sec</h3><span data-link="http://x">in</span>line<footer>End</footer></body></html>"""
    zones = [(f, " ".join(t.split())) for f, t, _ in page_zones(page)]
    assert [z for z in zones if z[1]] == [("title", "T & t"), ("body", "about"), ("h1", "Head one"), ("body", "First"), ("body", "Second"), ("body", "line"), ("headingLink", "sec"), ("heading", "Sec"), ("link", "http://x"), ("body", "inline"), ("body", "End")]


def test_own_rules_and_priority():
    rules = (Rule("body", "body"), Rule(".note", "note", priority=1), Rule('[data-mood]', None, (("data-mood", "mood"),), priority=2), Rule("p#x.note", "special", priority=3))
    page = '<body>a<p class="big note" data-mood="calm">b<i>c</i></p><p id=x class=note>d</p></body>'
    assert [(f, t) for f, t, _ in page_zones(page, rules, "i")] == [("body", "a"), ("mood", "calm"), ("note", "b"), ("special", "d")]
    assert matches("h2,h3", "h3", {}) and not matches('meta[name="a"]', "meta", {"name": "b"}) and matches("[hidden]", "p", {"hidden": ""}) and not matches("p.x", "p", {"class": "xy"})


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</div></div>", "<table><p></td></table>x", "<b><i></b></i>", "&#xZZ; <!-- ", "\x00"])
def test_malformed_pages(page):
    page_zones(page)


def test_json():
    assert json_records('[{"title": "a", "n": 1.50, "x": null}, 5, {"n": 12345678901234567890}]', {"n": "num", "title": "t", "x": "x"}) == [[("num", "1.50"), ("t", "a")], [("num", "12345678901234567890")]]
    with pytest.raises(ValueError):
        json_records('{"title": [1]}', {"title": "t"})


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_text("<title>A</title><body>alpha</body>")
    (tmp_path / "list.csv").write_text('title,body\n"One, two","first"\nThree,"sec\nond"\n')
    (tmp_path / "one.json").write_text(json.dumps({"title": "J", "body": "jay", "_add_files": "sub/more.json"}))
    (tmp_path / "sub/more.json").write_text(json.dumps([{"body": "more1", "_add_files": "../extra.txt"}, {"body": "more2", "_add_files": "missing.txt"}]))
    (tmp_path / "extra.txt").write_text("extra text")
    (tmp_path / "loop.json").write_text(json.dumps({"body": "loop", "_add_files": "./loop.json"}))
    (tmp_path / "plain.txt").write_text("plain")
    (tmp_path / "broken.pdf").write_bytes(b"no pdf")
    (tmp_path / "skip.bin").write_bytes(b"\x00")
    return str(tmp_path)


def test_a_folder(spark, folder):
    docs = load_folder(spark, folder).collect()
    texts = {(r["path"], r["doc_no"]): [(z["field"], z["text"]) for z in r["zones"]] for r in docs}
    assert texts["a.html", 0] == [("_relative_fp", "a.html"), ("title", "A"), ("body", "alpha")]
    assert texts["list.csv", 0] == [("title", "One, two"), ("body", "first")] and texts["list.csv", 1][1] == ("body", "sec\nond")
    assert texts["plain.txt", 0] == [("_relative_fp", "plain.txt"), ("body", "plain")]
    assert texts["broken.pdf", 0] == [("_relative_fp", "broken.pdf"), ("body", "")]
    assert [t for f, t in texts["one.json", 0] if f == "body"] == ["jay", "more1", "more2", "extra text"]
    # what is linked, by itself too, stays a document of its own
    assert sorted(texts) == [("a.html", 0), ("broken.pdf", 0), ("extra.txt", 0), ("list.csv", 0), ("list.csv", 1), ("loop.json", 0), ("one.json", 0), ("plain.txt", 0), ("sub/more.json", 0), ("sub/more.json", 1)]
    assert [t for f, t in texts["loop.json", 0] if f == "body"] == ["loop"]
    linked = {r["path"]: r["linked"] for r in docs}
    assert linked["one.json"] == ["sub/more.json", "extra.txt", "sub/missing.txt"]


def test_selectors():
    page = "<body>a<div id=d><section><p>b</p></section><p lang=en-GB>c</p></div><h2>H</h2><p>d</p><p class='x y'>e</p><span>f</span><ul><li>g<li>h<ol><li>i</ol></ul>"

    def picked(selector, excluded=""):
        return [t for f, t, _ in page_zones(page, (Rule("body", "body"), Rule(selector, "hit", priority=1)), excluded) if f == "hit"]

    assert picked("div p") == ["b", "c"] and picked("div > p") == ["c"] and picked("section>p,ul > li") == ["b", "g", "h", "i"]
    assert picked("h2 + p") == ["d"] and picked("h2 ~ p") == ["d", "e"] and picked("p.x.y") == ["e"] and picked("p:not(.x) ~ span") == ["f"]
    assert picked("li:first-child") == ["g", "i"] and picked("body p:first-of-type") == ["b", "c", "d"] and picked("#d *") == ["b", "c"]
    assert picked('[lang|="en"]') == ["c"] and picked('[class~=y]') == ["e"] and picked('[class^="x "]') == ["e"] and picked("[class$=y]") == ["e"] and picked("[class*=' ']") == ["e"]
    assert [t for _, t, _ in page_zones("<body>a<div><p>b</p>c</div><p>d</p>", (Rule("body", "body"),), "div > p")] == ["ac", "d"]
    for bad in ("p >", "", "p:hover", "..x"):
        with pytest.raises(ValueError):
            matches(bad, "p", {})


def _pdf(*pages, deflate=False, cmap=None):
    """A file of pages of content streams, the kids of two nodes of the page tree."""
    made = []

    def put(head, data=None):
        if data is not None:
            data = zlib.compress(data) if deflate else data
            head = b"<< " + head + (b" /Filter /FlateDecode" if deflate else b"") + b" /Length %d >>\nstream\n" % len(data) + data + b"\nendstream"
        made.append(head)
        return len(made)

    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    if cmap:
        font = b"<< /Type /Font /Subtype /Type0 /ToUnicode %d 0 R >>" % put(b"", cmap)
    font = put(font)
    contents = [put(b"", p) for p in pages]
    root = len(made) + len(pages) + 1
    kids = [put(b"<< /Type /Page /Parent %d 0 R /Contents [%d 0 R] >>" % (root, c)) for c in contents]
    put(b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 %d 0 R >> >> >>" % (b" ".join(b"%d 0 R" % k for k in reversed(kids)), len(kids), font))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, x) for i, x in enumerate(made, 1)) + b"trailer << /Root 1 0 R >>"


def test_pdf():
    first = b"BT /F1 12 Tf 72 700 Td (Second \\(page\\) \\351t\\351) Tj 0 -14 Td [(spa) -20 (ced) -300 (out)] TJ ET"
    other = b"BT /F1 12 Tf (First) Tj T* <68656C6C6F> Tj (next) ' ET BT 1 0 0 1 72 50 Tm (end) Tj ET"
    want = "First\nhello\nnext\nend\nSecond (page) \xe9t\xe9\nspaced out"
    assert pdf_text(_pdf(first, other)) == pdf_text(_pdf(first, other, deflate=True)) == want
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <4E2D> <0002> <00660069> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    assert pdf_text(_pdf(b"BT /F1 9 Tf <000100020010> Tj <00110012> Tj ET", deflate=True, cmap=cmap)) == "\u4e2dfiabc"
    assert pdf_text(b"") == pdf_text(b"no pdf") == pdf_text(_pdf(first) + b"/Encrypt") == ""


def test_csv_lines(spark, tmp_path):
    text = 'title,body\r\n#c1\r\na\u2028b\x85c\x0cd\x0be,"two\n#no comment\r\nlines"\r\n\r\n"#quoted",x\r\n#last'
    assert list(csv_rows(text, comment="#")) == [["title", "body"], ["a\u2028b\x85c\x0cd\x0be", "two\n#no comment\r\nlines"], ["#quoted", "x"]]
    assert list(csv_rows("a;'it''s';'b;c'", sep=";", quote="'")) == [["a", "it's", "b;c"]]
    (tmp_path / "big.csv").write_text("title,body\n" + "".join(f"t{i},b{i}\n" for i in range(25_001)))
    docs = load_folder(spark, str(tmp_path))
    rows = docs.select("doc_no", docs["zones"][0]["text"]).collect()
    assert sorted(tuple(r) for r in rows) == [(i, f"t{i}") for i in range(25_001)]


def test_links_however_deep_and_round(spark, tmp_path):
    for k in range(25):
        (tmp_path / f"{k:02d}.json").write_text(json.dumps({"body": f"b{k}", "_add_files": f"{k + 1:02d}.json"}))
    (tmp_path / "25.json").write_text(json.dumps({"body": "b25", "_add_files": "q/r/s/t/u/v/../../../../../../00.json"}))
    docs = {r["path"]: [z["text"] for z in r["zones"] if z["field"] == "body"] for r in load_folder(spark, str(tmp_path)).collect()}
    assert len(docs) == 26 and docs["00.json"] == [f"b{k}" for k in range(26)] and docs["25.json"] == ["b25", *(f"b{k}" for k in range(25))]


def test_linked_files_may_be_excluded(spark, folder):
    docs = load_folder(spark, folder, include=["*.json"], exclude=["sub/*"]).collect()
    assert sorted(r["path"] for r in docs) == ["loop.json", "one.json"]
    assert [z["text"] for r in docs for z in r["zones"] if r["path"] == "one.json" and z["field"] == "body"] == ["jay", "more1", "more2", "extra text"]


def test_include_and_exclude(spark, folder):
    names = lambda **k: sorted(r["path"] for r in walk(spark, folder, **k).select("path").collect())
    assert names(include=["*.json"]) == ["loop.json", "one.json", "sub/more.json"]
    assert names(include=["*.json"], exclude=["sub/*"]) == ["loop.json", "one.json"]
    assert "skip.bin" in names() and "skip.bin" not in names(exclude=["*.bin"])


def test_csv_by_number_and_options(spark, tmp_path):
    (tmp_path / "x.csv").write_text("# note\na;'b;b'\nc;d\n")
    loaders = Loaders(csv={1: "body", 0: "title", 7: "none"}, csv_options={"header": "false", "sep": ";", "quote": "'", "comment": "#"})
    got = [[(z["field"], z["text"]) for z in r["zones"]] for r in load_folder(spark, str(tmp_path), loaders).orderBy("doc_no").collect()]
    assert got == [[("body", "b;b"), ("title", "a")], [("body", "d"), ("title", "c")]]  # in the mapping's order


def test_numbers_follow_paths(spark, folder):
    got = number_documents(load_folder(spark, folder), after=9).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(10, 20)) and [r["path"] for r in got] == sorted(r["path"] for r in got)
