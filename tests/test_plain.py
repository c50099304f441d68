"""What needs no Spark: the query language, parameters, ontology, names, words."""

import pytest

from sparkloom import model
from sparkloom.functions import names as N
from sparkloom.functions import text as X
from sparkloom.operators import highlighting
from sparkloom.operators.fulltext import synonym_groups
from sparkloom.plans.params import Params, from_url
from sparkloom.plans.query_string import Node, parse
from sparkloom.plans.search import to_text


def shape(n: Node):
    return (n.kind, *[shape(p) for p in n.parts]) if n.parts else f"{n.field or ''}:{n.text}"


@pytest.mark.parametrize(
    "text, want",
    [
        ("a b", ":a b"),
        ("a OR b c", ("or", ":a", ":b c")),
        ("a AND b", ("and", ":a", ":b")),
        ("a -b", ("and", ":a", ("not", ":b"))),
        ("NOT a", ("not", ":a")),
        ("(a OR b) AND c", ("and", ("or", ":a", ":b"), ":c")),
        ("name:x y", ("and", "name:x", ":y")),
        ('names:"x y"', "names:x y"),
        ("a AND (b", ":a AND b"),
        ("", ":"),
    ],
)
def test_trees(text, want):
    assert shape(parse(text)) == want


def test_details():
    p = parse('"a b"~5^2')
    assert (p.kind, p.slop, p.boost) == ("phrase", 5, 2.0)
    assert parse("ab*").kind == "wildcard" and parse("*ab").kind == "words" and parse("ab~").slop == -1 and parse("ab~1").slop == 1
    r = parse("dates:{2020 TO *]")
    assert (r.low, r.high, r.closed) == ("2020", None, (False, True))
    assert parse("country:*").kind == "exists" and parse("*").kind == "all"
    assert parse("a b", "or").kind == "words"


def test_params_limits():
    assert Params([]).limit == 20 and from_url("", "limit=0").limit == 0 and from_url("", "limit=10").limit == 10
    p = from_url("", "limit=99999&offset=9000")
    assert (p.offset, p.limit) == (9000, 999)
    assert from_url("", "limit=x").limit == 20 and from_url("", "offset=-5").offset == 0


def test_params_filters():
    p = from_url("x", "filter:schema=Person&filter:schema=Company&filter:gte:dates=2020&filter:gte:dates=2021&exclude:a=1&empty:b=&sort=name:desc&sort=x:up&facet=a&facet_size:a=200")
    assert p.filters == {"schema": ["Person", "Company"]} and p.ranges == {"dates": {"gte": "2020"}}
    assert p.excludes == {"a": ["1"]} and p.empties == ["b"] and p.sorts == [("name", "desc")] and p.facet_size("a") == 200
    guest = Params(p.args, model.Auth())
    assert guest.facet_size("a") == 50 and not guest.facet_total("a")
    assert to_text(p) == 'x AND (schema:"Company" OR schema:"Person") AND -a:"1" AND -b:*'


def test_params_errors():
    with pytest.raises(RuntimeError):
        Params([], need_auth=True)
    with pytest.raises(RuntimeError):
        from_url("x", "q=y")
    with pytest.raises(RuntimeError):
        from_url("", "highlight_text=y")
    with pytest.raises(ValueError):
        from_url("", "filter:dataset=a b").datasets  # noqa: B018


def test_params_auth():
    p = Params([("filter:dataset", "a"), ("filter:dataset", "b")], model.Auth(frozenset(["b", "c"])))
    assert p.datasets == {"b"} and Params([], p.auth).datasets == {"b", "c"}


def test_ontology():
    assert model.concrete(["Organization"], True) == ["Company", "Organization", "PublicBody"]
    assert model.concrete(["Analyzable"]) == []
    assert [model.schema(n).bucket for n in ("Page", "Pages", "PlainText", "Person", "Payment", "Event", "Mention")] == ["page", "pages", "documents", "things", "intervals", "things", "things"]
    assert model.buckets_of(["Document"]) == ["documents", "pages"]
    assert "Company" in model.schema("Person").matchable_schemata or "LegalEntity" in model.schema("Person").matchable_schemata
    with pytest.raises(ValueError):
        model.write_bucket("Analyzable")
    with pytest.raises(ValueError):
        model.schema("Nothing")


def test_words():
    assert X.words_of("hello <h1 class='x'>Félix!</h1>") == ["hello", "felix"]
    assert X.words_of("Félix", "lower") == ["félix"]
    assert X.analyze_text(f"Hello Jane{X.ZWJ}__PER__ here", tokens_only=False) == [("hello", 0), ("jane", 1), ("__per__", 1), ("here", 2)]
    assert X.words_of("Straße & Œuvre") == ["strasse", "oeuvre"] and X.words_of("日本 x") == ["日", "本", "x"]
    assert X.analyze_text("Agent 007!", "names") == ["agent 007"]


def test_names():
    assert N.normalize_name("John O'Connor-Smith & Co.") == "john o connor smith co"
    assert N.ascii_text("Владимир Путин") == "vladimir putin"
    assert (N.metaphone("Vladimir"), N.metaphone("Putin")) == ("FLTMR", "PTN")
    assert N.clean_names(["Jane Doe", "jane  doe", "Jane", "J. D"]) == ["Jane Doe"]
    assert N.clean_names(["Jane"]) == [] and N.clean_names(["Schwarzenegger"]) == ["Schwarzenegger"] and N.clean_names(["a", "a"], strict=False) == ["a"]
    assert len(N.pick_names([f"name {i}" for i in range(20)], 5)) == 5 and N.pick_names(["b", "a"], 5) == ["a", "b"]
    assert N.edit_distance("kitten", "sitting") == 3


def test_marks():
    assert highlighting.marked("A <b> Félix ran", {"felix"}, []) == ("A &lt;b&gt; <em>Félix</em> ran", 1)
    assert highlighting.phrases_marked("by Jane A. Doe, and Doe Jane", [["jane", "doe"]], 2) == ("by <em>Jane A. Doe</em>, and <em>Doe Jane</em>", 2)
    got = highlighting.fragments("One two. " * 50 + "Here is felix. " + "Three. " * 50, {"felix"}, [], 60, 3, 300)
    assert len(got) == 1 and "<em>felix</em>" in got[0] and len(got[0]) < 100
    assert highlighting.fragments("no match", {"x"}, [], 60, 3, 5) == ["no ma"]


def test_synonyms():
    rules = synonym_groups(["vladimir, wladimir # a comment", "", "škuro, shkuro"])
    assert rules["vladimir"] == ["vladimir", "wladimir"] and "skuro" in rules
