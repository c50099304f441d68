"""The query families, the store and the streams over a small set of entities."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom import model, streaming
from sparkloom.functions.text import ZWJ
from sparkloom.operators import facets, geo, matching, phrases, significant, sorting
from sparkloom.operators import predicates as P
from sparkloom.operators.fulltext import SearchIndex, doc_stats, field_stats, load_index, postings, save_index, synonym_groups
from sparkloom.plans import search as S
from sparkloom.plans.params import Params, from_url
from sparkloom.sources import store, transform

ENTITIES = [
    ("p1", "Person", {"name": ["Anna Berg"], "nationality": ["se"], "birthDate": ["1970-08-21"], "email": ["ab@example.com"]}, "people"),
    ("p2", "Person", {"name": ["Berg, Anna"], "nationality": ["se"], "birthDate": ["1971"]}, "people"),
    ("p3", "Person", {"name": ["Anna Lind"], "nationality": ["no"], "email": ["ab@example.com"]}, "people"),
    ("p4", "Person", {"name": ["Владимир Иванов"], "alias": ["Vova Ivanov"]}, "people"),
    ("p5", "Person", {"name": ["Vladimir Ivanov"], "passportNumber": ["X1234567"]}, "people"),
    ("c1", "Company", {"name": ["Nordwind Shipping Limited"], "country": ["de"], "registrationNumber": ["HRB 555"]}, "firms"),
    ("c2", "Company", {"name": ["Nordwind Shipping Ltd"], "country": ["de"], "registrationNumber": ["HRB 555"]}, "firms"),
    ("c3", "Organization", {"name": ["Harbour Office"], "previousName": ["Old Harbour Office"]}, "firms"),
    ("d1", "PlainText", {"fileName": ["one.txt"], "bodyText": ["The cargo of Nordwind Shipping Limited went north. Anna Berg signed the contract."]}, "files"),
    ("d2", "PlainText", {"fileName": ["two.txt"], "bodyText": ["A report: Berg, as Anna A. Berg said, met Vladimir Ivanov near the harbour."]}, "files"),
    ("d3", "HyperText", {"title": ["Three"], "bodyText": ["<p>The harbour &amp; the cargo</p> and a Contractsigner"]}, "files"),
    ("d4", "PlainText", {"fileName": ["four.txt"], "bodyText": [f"Hello Jane{ZWJ}__PER__{ZWJ}__x1__ Doe and a crime story"]}, "files"),
    ("d5", "PlainText", {"fileName": ["five.txt"], "namesMentioned": ["Anna Berg"], "bodyText": ["nothing said about anyone at all"]}, "files"),
    ("g1", "Pages", {"fileName": ["g.pdf"], "indexText": ["cargo manifest of the harbour", "__translation__ Ladeliste des Hafens"]}, "files"),
    ("g1p", "Page", {"document": ["g1"], "bodyText": ["cargo manifest"], "index": ["1"]}, "files"),
    ("a1", "Address", {"full": ["Pier 1"], "latitude": ["54,3"], "longitude": ["10.1"]}, "places"),
    ("a2", "Address", {"full": ["Pier 2"], "latitude": ["54.4"], "longitude": ["10.2", "bad"]}, "places"),
    ("a3", "Address", {"full": ["Far"], "latitude": ["-10"], "longitude": ["100"]}, "places"),
    ("y1", "Payment", {"amount": ["100"], "date": ["2024-01-10"], "payer": ["c1"]}, "money"),
    ("y2", "Payment", {"amount": ["250"], "date": ["2024-02-10"], "payer": ["c2"]}, "money"),
    ("y3", "Payment", {"amount": ["150"], "date": ["2024-04-10"]}, "money"),
    ("e1", "Event", {"name": ["First"], "date": ["2020"]}, "events"),
    ("e2", "Event", {"name": ["Second"], "date": ["2021"]}, "events"),
    ("x1", "Analyzable", {"language": ["en"]}, "files"),
]


@pytest.fixture(scope="module")
def entities(spark):
    rows = [(i, s, p, [d]) for i, s, p, d in ENTITIES]
    return spark.createDataFrame(rows, "id string, schema string, properties map<string,array<string>>, datasets array<string>")


@pytest.fixture(scope="module")
def index(spark, entities, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index"))
    transform.documents(entities, symbols={"vladimir": "N1", "владимир": "N1"}).write.parquet(f"{at}/docs")
    docs = spark.read.parquet(f"{at}/docs")
    save_index(docs, f"{at}/index", buckets=4)
    return load_index(spark, f"{at}/index", docs)


def ids(result):
    df = result.hits if isinstance(result, S.Result) else result
    return [r._id for r in df.select("_id").collect()]


def find(index, q="", args="", **kw):
    return ids(S.search_query_string(index, q, args, **kw))


ANY = "filter:schemata=Thing&filter:schemata=Interval"


def test_documents(index):
    rows = {r._id: r for r in index.docs.collect()}
    assert "x1" not in rows and len(rows) == len(ENTITIES) - 1
    p = rows["p1"]
    assert p.caption == "Anna Berg" and p.schemata == ["Person", "LegalEntity", "Thing"] and p.names == ["anna berg"] and p.name_keys == ["annaberg"]
    assert p.name_parts == ["anna", "berg"] and p.countries == ["se"] and p.emails == ["ab@example.com"] and p.num_values == 4
    assert rows["p4"].name_keys == ["ivanovvladimir", "ivanovvova"] and "FLTMR" in rows["p5"].name_phonetic
    assert rows["c1"].name_keys == ["ltdnordwindshipping"] == rows["c2"].name_keys
    assert [(g.lon, g.lat) for g in rows["a1"].geo_point] == [(10.1, 54.3)]
    assert rows["g1"].content == ["cargo manifest of the harbour"] and rows["g1"].translation == ["Ladeliste des Hafens"]
    assert rows["e1"].numeric == {"date": [1577836800.0], "dates": [1577836800.0]} and rows["y1"].entities == ["c1"]
    assert rows["g1p"].index_bucket == "page" and rows["y1"].index_bucket == "intervals" and not p.mutable


def test_merged_fragments(spark):
    rows = [("a", "Folder", {"fileName": ["x"]}, ["2020"], ["u1"]), ("a", "Document", {"fileName": ["x", "y"]}, ["2019"], ["u2"]), ("b", "Person", None, None, None)]
    df = spark.createDataFrame(rows, "id string, schema string, properties map<string,array<string>>, created_at array<string>, origin array<string>")
    got = {r.id: r for r in transform.merge_fragments(df).collect()}
    assert got["a"].schema == "Folder" and got["a"].properties == {"fileName": ["x", "y"]} and got["a"].origin == ["u1", "u2"] and got["b"].properties == {}


def test_text(index):
    assert sorted(find(index, "cargo")) == ["d1", "d3", "g1"]
    assert sorted(find(index, "cargo harbour")) == ["d3", "g1"]
    assert sorted(find(index, "contract OR report")) == ["d1", "d2"]
    assert find(index, "cargo AND signed") == ["d1"]
    assert find(index, "contract") == ["d1"]
    assert sorted(find(index, "cargo -signed")) == ["d3", "g1"]
    assert find(index, '"anna berg"', "filter:schema=PlainText") and "d2" not in find(index, '"anna berg"', "filter:schema=PlainText")
    assert "d2" in find(index, '"anna berg"~2', "filter:schema=PlainText")
    assert find(index, '"crime __PER__"~5') == ["d4"] and find(index, "__x1__ AND crime") == ["d4"]
    assert find(index, "Ladeliste") == ["g1"] and find(index, "manif*") == ["g1"] and find(index, "manifets~") == ["g1"]
    assert find(index, "Владимир") == ["p4"]
    assert find(index, "emails:ab@example.com AND name:lind") == ["p3"]
    assert find(index, "no such words") == []


def test_index_as_stored_and_as_made(spark, index):
    made = SearchIndex(index.docs)
    for q in ("cargo", "cargo harbour", "contract OR report", "cargo -signed", '"anna berg"~2', "manif*", "manifets~", "name:lind OR contract", "emails:ab@example.com OR cargo"):
        rows = [{(r._id, round(r.score, 9)) for r in i.search(S.parse(q)).collect()} for i in (index, made)]
        assert rows[0] == rows[1] and rows[0], q
    stats = [{(r.field, r.n_docs, round(r.avg_dl, 9)) for r in d.collect()} for d in (index.stats, doc_stats(index.docs, list(index.fields)), field_stats(postings(index.docs, list(index.fields))))]
    assert stats[0] == stats[1] == stats[2]
    plan = index.search(S.parse("content:cargo"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "tb" in plan.split("PartitionFilters")[1]


def test_or_over_a_field_that_is_not_searched(spark):
    docs = spark.createDataFrame([("1", "alpha beta", "foo"), ("2", "gamma", "bar")], "_id string, content string, name string")
    index = SearchIndex(docs, fields={"content": 1.0})
    assert sorted(r._id for r in index.search(S.parse("name:foo OR gamma")).collect()) == ["1", "2"]


def test_scores_put_names_first(index):
    assert find(index, "nordwind shipping")[0] in ("c1", "c2")


def test_prefix_filters_pages(index):
    assert sorted(find(index, "", "prefix=nordw")) == ["c1", "c2"]
    assert find(index, "", "filter:emails=ab@example.com&filter:countries=no") == ["p3"]
    assert find(index, "", "filter:names=ANNA%20Berg&filter:schema=Person") == ["p1"]
    assert find(index, "", "filter:gte:properties.birthDate=1970-08-01&filter:lt:properties.birthDate=1971") == ["p1"]
    assert sorted(find(index, "", "filter:gte:dates=1970||/y&filter:lte:dates=1971||/y")) == ["p1", "p2"]
    assert sorted(find(index, "", "filter:schema=Address&empty:emails=1&exclude:_id=a3")) == ["a1", "a2"]
    assert find(index, "", "filter:schema=Page") == ["g1p"] and "g1p" not in find(index, "", "limit=100")
    first, second = find(index, "", f"{ANY}&sort=_id&limit=3"), find(index, "", f"{ANY}&sort=_id&limit=3&offset=3")
    assert first == ["a1", "a2", "a3"] and second[0] == "c1"
    assert find(index, "", "filter:schema=Event&sort=dates") == ["e1", "e2"] and find(index, "", "filter:schema=Event&sort=dates:desc") == ["e2", "e1"]


def test_access(index):
    assert find(index, "cargo", auth=model.Auth()) == []
    assert find(index, "", auth=model.Auth(frozenset(["places"]))) == ["a1", "a2", "a3"]
    assert len(find(index, "cargo", auth=model.Auth(is_admin=True))) == 3


def test_facets(index):
    r = S.search_query_string(index, "", "filter:schema=Person&facet=countries&facet_total:countries=true&filter:countries=se&facet=schema")
    assert [tuple(x) for x in r.facets["countries.values"].collect()] == [("se", 2), ("no", 1)]
    assert r.facets["countries.cardinality"].first().n == 2 and sorted(ids(r)) == ["p1", "p2"] and r.total == 2
    r = S.search_query_string(index, "", "filter:schema=Payment&facet=dates&facet_interval:dates=month&metric:sum=amount&metric:avg=amount&metric:bad=amount&filter:gte:dates=2023-12")
    rows = r.facets["dates.intervals"].orderBy("key").collect()
    assert [x.n for x in rows] == [0, 1, 1, 0, 1] and [x.amount_sum for x in rows] == [None, 100, 250, None, 150]
    m = r.facets["metrics"].first()
    assert m.amount_sum == 500 and round(m.amount_avg, 2) == 166.67


def test_significant(spark, index):
    r = S.search_query_string(index, "", "filter:schema=Person&facet_significant=dataset&facet_significant_text=content")
    assert ids(r) == [] and [x.key for x in r.facets["dataset.significant_terms"].collect()] == ["people"]
    rows = [(str(i), ["a", "b"] if i < 6 else ["c", "a"] if i < 20 else ["c"], float(i), f"s{i % 2}") for i in range(40)]
    d = spark.createDataFrame(rows, "_id string, tags array<string>, score double, dataset string")
    got = significant.nested(d.where("_id < '6' and length(_id) = 1"), d, "tags", 5, 2).collect()
    assert {(x.outer, x.key) for x in got} == {("a", "b"), ("b", "a")}
    assert significant.sample(d, "top", 3).count() == 3 and significant.sample(d, "diversified", 3).count() == 6
    assert significant.sample(d, "none", 3).count() == 40 and 0 < significant.sample(d, "random", 3, 0.5).count() < 40


def test_projection_and_highlights(index):
    r = S.search_query_string(index, "cargo", "dehydrate=true")
    assert "properties" not in r.hits.columns and {"schema", "caption", "dataset"} <= set(r.hits.columns) and "content" not in r.hits.columns
    r = S.search_query_string(index, "", "filter:schema=Person&dehydrate=true&include_fields=emails&limit=1&sort=_id")
    assert r.hits.first().properties == {"email": ["ab@example.com"]}
    rows = S.search_query_string(index, "signed", "highlight=true").rows()
    assert rows[0]["highlight"]["content"] == ["Anna Berg <em>signed</em> the contract."] or "<em>signed</em>" in rows[0]["highlight"]["content"][0]


def test_synonyms(index):
    rules = synonym_groups(["freight, cargo"])
    assert find(index, "freight") == [] and find(index, "freight", synonyms=rules) == []
    assert sorted(find(index, "freight", "synonyms=true", synonyms=rules)) == ["d1", "d3", "g1"]


def test_name_keys_and_symbols_of_the_text(index):
    assert find(index, "Nordwind Shipping Limited Kiel") == []
    assert sorted(find(index, "Nordwind Shipping Limited Kiel", "synonyms=true")) == ["c1", "c2"]
    q = S.EntitiesQuery(index, from_url("Vladimir Nobody", "synonyms=true"), symbols={"vladimir": "N1"})
    assert sorted(ids(q.search())) == ["p4", "p5"]


def test_bodies(index):
    body = {"query": {"bool": {"must": {"term": {"schema": "Person"}}, "must_not": [{"exists": {"field": "emails"}}], "should": [{"prefix": {"name_parts": "iva"}}], "minimum_should_match": 1}}}
    assert sorted(ids(S.search_body(index, body))) == ["p4", "p5"]
    assert ids(S.search_body(index, {"query": {"match_phrase": {"content": {"query": "the contract"}}}})) == ["d1"]
    assert ids(S.search_body(index, {"query": {"match_none": {}}})) == []
    mixed = {"query": {"bool": {"must": [{"match": {"content": "cargo"}}], "must_not": {"match_phrase": {"content": "the contract"}}, "filter": {"terms": {"_id": ["d1", "d3"]}}}}}
    assert ids(S.search_body(index, mixed)) == ["d3"]
    with pytest.raises(ValueError):
        S.search_body(index, {"query": {"bool": {"must": {"odd": {"a": 1}}}}})


def test_matches(index):
    got = ids(S.MatchQuery(index, from_url(""), "p1").search())
    assert got == ["p2"]
    assert ids(S.MatchQuery(index, from_url(""), "c1").search()) == ["c2"] and ids(S.MatchQuery(index, from_url(""), "d1").search()) == []
    assert ids(S.MatchQuery(index, from_url(""), "p4").search()) == ["p5"]
    assert ids(S.MatchQuery(index, from_url(""), "c1", exclude=["c2"]).search()) == []
    assert set(ids(S.blocking_query(index, "c1"))) == {"c2"} and "p5" in ids(S.blocking_query(index, "p4"))
    pairs = {(r.a, r.b) for r in matching.blocking_pairs(index.docs).collect()}
    assert {("c1", "c2"), ("p1", "p2"), ("p4", "p5")} <= pairs


def test_joins_are_equi_joins(index):
    for df in (matching.blocking_pairs(index.docs), matching.matches(index.docs, index.docs), phrases.mentions(phrases.names_of(index.docs), index.docs)):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_percolation(index):
    r = S.PercolatorQuery(index, from_url("", "highlight=true"), text="Said by Berg Anna of the old harbour office.").search()
    got = {x["_id"]: x for x in r.rows()}
    assert {"p1", "c3"} <= set(got) and got["c3"]["percolator_match"] == ["name", "other_name"] and got["p1"]["surface_forms"] == ["Berg Anna"]
    assert got["p1"]["highlight"]["content"] == ["Said by <em>Berg Anna</em> of the old harbour office."] and got["c3"]["surface_forms"] == ["old harbour office"]
    assert [x["surface_forms"] for x in S.PercolatorQuery(index, from_url(""), text="Said by Berg Anna.").search().rows()] == [[]] * 2
    r = S.PercolatorQuery(index, from_url(""), entity_id="d1").search()
    assert {"c1", "p1"} <= set(ids(r))
    for kw in ({}, {"text": "a", "entity_id": "b"}):
        with pytest.raises(ValueError, match="exactly one"):
            S.PercolatorQuery(index, from_url(""), **kw)
    for wrong in ("p1", "g1p", "nobody"):
        with pytest.raises(ValueError, match="No percolatable fulltext"):
            S.PercolatorQuery(index, from_url(""), entity_id=wrong)


def test_mentions(index):
    got = {x["_id"]: x for x in S.MentionsQuery(index, from_url(""), "p1").search().rows()}
    assert set(got) == {"d1", "d2", "d5"} and got["d1"]["mention_sources"] == ["p1"]
    assert ids(S.MentionsQuery(index, from_url("contract"), "p1").search()) == ["d1"]
    marked = {x["_id"]: x["highlight"]["content"] for x in S.MentionsQuery(index, from_url("", "highlight=true"), "p1").search().rows()}
    assert "<em>Anna Berg</em> signed" in marked["d1"][0] and set(marked) == {"d1", "d2", "d5"}
    r = S.MultiMentionsQuery(index, from_url(""), from_url("", "filter:schema=Person&filter:schema=Company")).search()
    rows = {x["_id"]: x["mention_sources"] for x in r.rows()}
    assert rows["d1"] == ["c1", "p1", "p2"] or set(rows["d1"]) >= {"c1", "p1"}
    assert set(rows["d2"]) >= {"p1", "p5"}
    r = S.search_query_string(index, "", "filter:schema=Person&facet_significant=names&facet_significant_type:names=nested")
    assert "names.significant_nested" in r.facets
    with pytest.raises(ValueError, match="Source filter"):
        S.MultiMentionsQuery(index, from_url(""), from_url("", "filter:schema=Person"), max_names=1)
    for bad, why in (("", "entity_id"), ("nobody", "not found"), ("y1", "no matchable names")):
        with pytest.raises(ValueError, match=why):
            S.MentionsQuery(index, from_url(""), bad)


def test_more_like_this(index):
    got = ids(S.MoreLikeThisQuery(index, from_url("", "mlt_min_word_length=4"), "g1").search())
    assert got and "g1" not in got and "d3" in got and "g1p" not in got
    assert ids(S.MoreLikeThisQuery(index, from_url(""), "g1", datasets=["nowhere"]).search()) == []


def test_geo(spark, index):
    r = S.GeoDistanceQuery(index, from_url(""), "a1").search()
    rows = r.rows()
    assert [x["_id"] for x in rows] == ["a2", "a3"] and 12 < rows[0]["distance_km"] < 14
    assert ids(S.GeoDistanceQuery(index, from_url(""), "p1").search()) == []
    import math

    pts = [(str(i), (i * 37.7) % 360 - 180, (i * 13.3) % 170 - 85) for i in range(120)]
    want = set()
    for a, x1, y1 in pts:
        for b, x2, y2 in pts:
            d = min(abs(x1 - x2), 360 - abs(x1 - x2))
            km = geo.RADIUS_KM * math.hypot(math.radians(d) * math.cos(math.radians((y1 + y2) / 2)), math.radians(y1 - y2))
            if a != b and km <= 1200:
                want.add((a, b))
    got = {(r.a, r.b) for r in geo.nearest_pairs(spark.createDataFrame(pts, "_id string, lon double, lat double"), 1200.0).collect()}
    assert got == want and want


def test_sorting_is_reversed_and_missing_last(spark):
    d = spark.createDataFrame([("a", 1, None), ("b", 1, 5), ("c", 2, 7)], "_id string, x int, y int")
    assert ids(sorting.page(d, [("y", "desc"), ("x", "asc")])) == ["b", "a", "c"]
    assert ids(sorting.page(d, [("y", "asc")])) == ["b", "c", "a"] and ids(sorting.page(d, [("y", "desc")])) == ["c", "b", "a"]
    assert ids(sorting.page(d, [("nothing", "asc")], 1, 1)) == ["b"]


def test_empty_and_missing(spark, index):
    none = SearchIndex(index.docs.limit(0), index.post.limit(0))
    assert find(none, "cargo") == [] and find(none) == []
    assert facets.terms(none.docs, "countries").collect() == [] and facets.date_histogram(none.docs, "dates", "day").collect() == []
    assert P.filter_text("a", []) == "a:*" and field_stats(none.post).count() == 0


def test_store(spark, entities, tmp_path):
    s = store.EntityStore(spark, f"{tmp_path}/t")
    with pytest.raises(ValueError):
        s.read()
    s.create(transform.documents(entities))
    assert s.read().count() == 0
    assert s.index("one", entities) == (len(ENTITIES) - 1, 0) and s.index("one", entities).indexed == len(ENTITIES) - 1
    assert s.read().count() == len(ENTITIES) - 1
    before = s.version_of("p1")
    s.index("two", entities.where("id = 'p1'"))
    assert s.version_of("p1") > before and s.read().where("_id = 'p1'").first().dataset == "two"
    assert [r._id for r in s.scan(dataset="one", schemata=["Event"], sort="_id:desc").collect()] == ["e2", "e1"]
    assert s.scan(auth=model.Auth()).count() == 0
    assert [r._id for r in s.adjacent("c1").collect()] == ["y1"] and s.content_of("d1").startswith("The cargo") and s.content_of("p1") is None
    assert s.delete_ids(["p1", "nobody"]) == 1 and s.version_of("p1") is None
    assert s.delete(F.col("schema") == "Person") == 4
    s.export_actions(f"{tmp_path}/out", F.col("dataset") == "one")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert len(lines) == len(ENTITIES) - 6 and "name_keys" not in lines[0]["_source"]
    s.export_actions(f"{tmp_path}/full", hidden_columns=True)
    again = store.EntityStore(spark, f"{tmp_path}/u")
    assert again.upsert(store.read_actions(spark, f"{tmp_path}/full", s.read().drop("seq").schema)).indexed == s.read().count()
    s.create(s.read().withColumn("more", F.lit(1)))
    assert "more" in s.read().columns
    with pytest.raises(ValueError):
        s.create(s.read().withColumn("more", F.lit("text")))
    s.clear()
    assert s.read().count() == 0
    s.drop()
    assert s.version() == 0


def test_writes_that_die_lose_nothing(spark, entities, tmp_path, monkeypatch):
    s = store.EntityStore(spark, f"{tmp_path}/t", 4)
    people = entities.where("schema = 'Person'")
    with monkeypatch.context() as m:
        m.setattr(store.EntityStore, "_place", lambda self, fresh, n: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            s.index("one", people)
    assert s.version() == 0
    s.index("one", people)
    before, files = sorted(ids(s.read())), s._current()["parts"]
    for step in ("_place", "_forget"):
        with monkeypatch.context() as m:
            m.setattr(store.EntityStore, step, lambda self, *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                s.index("one", entities.where("id = 'c1'"))
        assert sorted(ids(s.read())) == (before if step == "_place" else sorted([*before, "c1"]))
    s.index("two", entities.where("id = 'p1'"))
    now = s._current()["parts"]
    assert sorted(ids(s.read())) == sorted([*before, "c1"]) and sum(files.get(k) != v for k, v in now.items()) <= 2  # the parts of c1 and p1
    twice = entities.where("id = 'p2'").withColumn("n", F.lit(1)).union(entities.where("id = 'p2'").withColumn("properties", F.create_map(F.lit("name"), F.array(F.lit("Last One")))).withColumn("n", F.lit(2)))
    s.index("one", twice.drop("n").coalesce(1))
    assert s.by_ids(["p2"]).first().caption == "Last One"
    other = store.EntityStore(spark, s.path)
    stale = s._current()
    other.delete_ids(["p3"])
    with pytest.raises(RuntimeError, match="another write"):
        s._publish(s.read().limit(0), stale, set())
    assert "p3" not in ids(s.read()) and {r.id for r in s.entities().collect()} == set(ids(s.read()))
    assert s.put({"id": "q", "schema": "Person", "properties": {"name": ["Quite New"]}}, "one") == (1, 0)
    index = s.search_index(4)
    assert [r._id for r in index.search(S.parse("quite")).collect()] == ["q"] and s.search_index().post.count() == index.post.count()


def test_names_picked_in_batches(spark):
    from sparkloom.functions import names as N

    rows = [("anna berg", "anna bergh", "ana berg", "zed", "hanna bergman", "a b", "annabel"), ("x", "y")]
    got = spark.createDataFrame([(list(r),) for r in rows], "n array<string>").select(matching.picked(F.col("n"), 4).alias("p")).collect()
    assert [r.p for r in got] == [N.pick_names(list(r), 4) for r in rows]


def test_json_lines_and_duplicates(spark, tmp_path):
    lines = [json.dumps({"id": "a", "schema": "Person", "properties": {"name": ["X Y"]}, "mutable": True, "origin": ["u", "v"]}), "not json", json.dumps({"schema": "Person"})]
    (tmp_path / "e.json").write_text("\n".join(lines))
    row = store.read_entities(spark, str(tmp_path / "e.json")).collect()
    assert [r.id for r in row] == ["a", None, None] and row[0].origin == ["u", "v"] and row[0].mutable == ["true"]
    assert store.EntityStore(spark, f"{tmp_path}/t").index("one", store.read_entities(spark, str(tmp_path / "e.json"))) == (1, 2)
    d = spark.createDataFrame([("a", "pages"), ("a", "documents"), ("b", "documents")], "_id string, index_bucket string")
    assert ids(store.cross_bucket_duplicates(d)) == ["a"]
    assert sorted(tuple(r) for r in store.without_cross_bucket_duplicates(d).collect()) == [("a", "pages"), ("b", "documents")]
    c = spark.createDataFrame([("1", ["x", "x"]), ("2", ["x"]), ("3", None)], "_id string, checksums array<string>")
    assert {tuple(r) for r in store.checksum_counts(c, spark.createDataFrame([("x",), ("y",)], "checksum string")).collect()} == {("x", 2), ("y", 0)}


def test_streams(spark, entities, index, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"id": "n1", "schema": "Person", "properties": {"name": ["New One"]}}) + "\n")
    s = store.EntityStore(spark, f"{tmp_path}/t")
    streaming.ingest(streaming.entity_stream(spark, f"{tmp_path}/in"), s, "live", f"{tmp_path}/cp").awaitTermination()
    assert ids(s.read()) == ["n1"]
    texts = spark.createDataFrame([("t1", "now Berg, Anna came"), ("t2", "Anna went to Berg and a b c d e"), ("t3", "")], "_id string, content string")
    texts.write.parquet(f"{tmp_path}/texts")
    live = spark.readStream.schema(texts.schema).parquet(f"{tmp_path}/texts")
    names = phrases.names_of(index.docs.where("_id = 'p1'"))
    q = streaming.percolate_stream(live, names).writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r._id, r.entity_id) for r in spark.table("hits").collect()} == {("t1", "p1"), ("t2", "p1")} or {r._id for r in spark.table("hits").collect()} == {"t1"}
    batch = phrases.percolate(names, texts).collect()
    assert {r._id for r in batch} == {r._id for r in spark.table("hits").collect()}


def test_auth_params_guard():
    with pytest.raises(RuntimeError):
        Params([], need_auth=True)
