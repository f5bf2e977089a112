"""The query language: trees of queries, with terms as if the dictionary held them all."""

import json

import pytest

from sondeur.config import IndexConfig
from sondeur.functions.analysis import Analyzer
from sondeur.plans.query import GROUP, PHRASE, parse, to_json

ASCII, CHINESE = Analyzer(IndexConfig()), Analyzer(IndexConfig(analyzer="chinese"))


def show(parts):
    """A compact form: operators, field, then the term, 'a b' for phrases and (a b) for groups; * wildcard, . no expansion."""
    out = []
    for p in parts:
        s = "+" * p.mandatory + "-" * p.subtracted + "~" * p.inverted + (f"{p.field_name}:" if p.field_name else "")
        if p.kind == PHRASE:
            s += "'" + " ".join(c.original for c in p.children) + "'"
        elif p.kind == GROUP:
            s += "(" + " ".join(show(p.children)) + ")" if p.children is not None else "(?"
        else:
            s += p.original + "*" * p.wildcard
        out.append(s)
    return out


def read(text, analyzer=ASCII, phrases=True):
    return show(parse(text, analyzer, ["title", "body"], phrases))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", []), (" ", []), ("alder birch", ["alder", "birch"]), ("AlDeR", ["alder"]),
        # operators stand right before a term, after a blank or nothing
        ("-", []), (" ~", []), ("-alder", ["-alder"]), (" +alder", ["+alder"]), ("~alder", ["~alder"]), ("--alder", ["-alder"]), ("++alder", ["+alder"]),
        ("- alder", ["alder"]), (" ~ alder", ["alder"]), ("alder-birch", ["alder", "birch"]), ("alder~birch", ["alder", "birch"]), ("alder -birch", ["alder", "-birch"]),
        (" +~alder -birch -~alder", ["+~alder", "-birch", "-~alder"]), ("+-alder", ["-alder"]), ("-+alder", ["+alder"]), ("~-alder", ["-~alder"]),
        # around phrases and groups
        ('"alder"-birch', ["'alder'", "-birch"]), ("(alder)-birch", ["(alder)", "-birch"]), ('birch-"alder"', ["birch", "'alder'"]), ("birch -(alder)", ["birch", "-(alder)"]),
        ('"alder birch"', ["'alder birch'"]), ('"(alder birch)"', ["'alder birch'"]), ('alder"alder birch"', ["alder", "'alder birch'"]), ('"alder birch', ["alder", "birch"]),
        ("“alder birch”", ["'alder birch'"]),
        ("(alder birch)alder(alder birch)", ["(alder birch)", "alder", "(alder birch)"]), ("((alder birch) alder) (alder()birch)", ["((alder birch) alder)", "(alder () birch)"]),
        ("(alder birch", ["(?", "alder", "birch"]), ("alder) birch", ["alder", "birch"]),
        # fields
        ("title:alder birch", ["title:alder", "birch"]), ("alder title: ", ["alder"]), ("title:(alder body:birch)", ["title:(alder body:birch)"]), ("title:~ alder birch)", ["title:alder", "birch"]),
        ("title:~alder birch)", ["~title:alder", "birch"]), ("invalid: alder ~birch)", ["invalid", "alder", "~birch"]), ("http://server:9090 +alder", ["http", "server", "9090", "+alder"]),
        ("title:-+alder", ["+title:alder"]), ("title:+-alder", ["-title:alder"]), ('title: "alder birch"', ["title:'alder birch'"]),
        ("title:+(+alder +birch) -(alder birch) body:(alder ~birch)", ["+title:(+alder +birch)", "-(alder birch)", "body:(alder ~birch)"]),
        ("+body:birch +http://server:9090 -(title:alder)", ["+body:birch", "+http", "server", "9090", "-(title:alder)"]),
        ('title:"+alder +birch" ~title:("alder birch")', ["title:'alder birch'", "~title:('alder birch')"]),
        ("title:(+alder +body:(alder birch)) -title:((body:\"alder\") birch)", ["title:(+alder +body:(alder birch))", "-title:((body:'alder') birch)"]),
        # escapes and wildcards
        (r"title:(alder) \(-alder birch) \+title\:alder\+birch \-alder \~birch", ["title:(alder)", "-alder", "birch", "title", "alder", "birch", "alder", "birch"]),
        ("alder* birch", ["alder*", "birch"]), ("alder birch*", ["alder", "birch*"]),
    ],
)
def test_trees(text, expected):
    assert read(text) == expected


def test_without_positions_quotes_are_ordinary():
    assert read('"alder birch"', phrases=False) == ["alder", "birch"]


def test_han_characters_end_operators():
    assert read("我-(alder)") == ["(alder)"]
    assert read("我-(alder)", CHINESE) == ["我", "-(alder)"]


def test_a_trailing_blank_stops_expansion():
    assert [p.auto_suffix for p in parse("alder birch", ASCII, [])] == [True, True]
    assert [p.auto_suffix for p in parse("alder birch ", ASCII, [])] == [False, False]


def test_forms_of_a_term():
    (p,) = parse("d'Été", ASCII, [])
    assert p.term == "dete" and p.forms == ["d'Été", "d'ete", "d’ete", "dete"]


def test_json_round_trip():
    (p,) = json.loads(to_json(parse('+title:"a b"', ASCII, ["title"])))
    assert p["isMandatory"] and p["fieldName"] == "title" and p["partType"] == "PHRASE" and [c["term"] for c in p["children"]] == ["a", "b"]
