"""What keeps plans in bounds on larger tables."""

import re

from sparkloom.functions.text import ZWJ
from sparkloom import streaming
from sparkloom.operators import fulltext, highlighting, matching, phrases
from sparkloom.sources import store
from sparkloom.sources.store import EntityStore


def _people(spark, ids, name):
    return spark.createDataFrame([(i, "things", f"{name} {i}") for i in ids], "_id string, index_bucket string, caption string").coalesce(1)


def test_upsert_neither_broadcasts_ids_nor_sorts_documents(spark, tmp_path, monkeypatch):
    plans, publish = [], EntityStore._publish

    def seen(self, df, *more):
        plans.append(df._jdf.queryExecution().toString())
        publish(self, df, *more)

    monkeypatch.setattr(EntityStore, "_publish", seen)
    s = EntityStore(spark, str(tmp_path / "s"), 2)
    s.upsert(_people(spark, ["a", "b", "c"], "First"))
    s.upsert(_people(spark, ["d", "e"], "Second"))
    assert len(plans) == 2 and not any(w in p for p in plans for w in ("BroadcastHashJoin", "Window"))
    assert {r._id for r in s.read().collect()} == set("abcde")


def test_upsert_of_more_ids_than_are_sent(spark, tmp_path, monkeypatch):
    """The last row of an id counts, whether ids are sent to all tasks or shuffled."""
    for few, rows in ((100_000, 100_000), (0, 2)):
        monkeypatch.setattr(store, "FEW_IDS", few)
        monkeypatch.setattr(store, "ROWS", rows)
        monkeypatch.setattr(store, "IDS", rows)
        s = EntityStore(spark, str(tmp_path / f"s{few}"), 2)
        s.upsert(_people(spark, ["a", "b", "c", "d"], "First"))
        assert s.upsert(_people(spark, ["a", "x"], "Old").union(_people(spark, ["a", "b"], "New"))) == (4, 0)
        assert {r._id: r.caption for r in s.read().collect()} == {"a": "New a", "b": "New b", "c": "First c", "d": "First d", "x": "Old x"}
        wanted = spark.createDataFrame([("a",), ("a",), ("d",), ("no",)], "_id string")
        assert sorted(r._id for r in s.by_ids(wanted).collect()) == ["a", "d"]


def test_units_and_tiles_meet_once(spark, monkeypatch):
    """Blocks of two members and tiles of two units give each pair once; nothing is made distinct afterwards."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(matching, "BLOCK", 2)
    monkeypatch.setattr(matching, "TILE", 2)
    rows = [(f"{i:02d}", "Company", [f"n{i % 5}"], [f"key{i % 5}", f"more{i % 3}"], ["BRNT"] if i % 4 else [], [], []) for i in range(40)]
    kinds = "_id string, schema string, names array<string>, name_keys array<string>, name_phonetic array<string>, name_symbols array<string>, identifiers array<string>"
    docs = spark.createDataFrame(rows, kinds)
    found = matching.blocking_pairs(docs)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    keys = {r[0]: {*r[3], *r[4]} for r in rows}
    want = sorted((a, b) for a in keys for b in keys if a < b and keys[a] & keys[b])
    assert sorted((r.a, r.b) for r in found.collect()) == want
    full = docs.withColumns({"name_parts": F.col("name_keys"), "properties": F.create_map(F.lit("sector"), F.array(F.lit("shipping and trade")))})
    both, one = matching.matches(full, full), matching.matches(full.where("true"), full)
    assert "Aggregate" not in both._jdf.queryExecution().optimizedPlan().toString()
    got = [{(r.source_id, r._id): round(r.score, 6) for r in x.collect()} for x in (both, one)]
    assert got[0] == got[1] and len(got[0]) == both.count()


def test_written_index_is_that_of_postings(spark, tmp_path, monkeypatch):
    """Words grouped where they are read, in small parts: as the shuffled ones, without a
    second analysis of the texts."""
    monkeypatch.setattr(fulltext, "WORDS", 3)
    rows = [
        ("1", "The the cat, the end", ["one two one", "two three"], ["a", "b", "a"]), ("2", None, None, None), ("3", "", ["", None, "x"], []), ("4", f"ein{ZWJ}__P__{ZWJ} Haus ein", ["solo"], ["a"]),
        ("5", "..., !", [], None), ("6", " ".join(f"w{i % 7}" for i in range(50)), ["z"], ["c"]),
    ]
    docs = spark.createDataFrame(rows, "_id string, content string, name array<string>, names array<string>").coalesce(1)
    fields = ["content", "name", "names"]
    made, analysed = [], fulltext._analysed
    monkeypatch.setattr(fulltext, "_analysed", lambda d, f: made.append(analysed(d, f)) or made[-1])
    fulltext.save_index(docs, f"{tmp_path}/i", fields, 4)
    assert "Exchange" not in made[0]._jdf.queryExecution().executedPlan().toString()
    index = fulltext.load_index(spark, f"{tmp_path}/i", docs)
    of = lambda df: sorted((r.field, r.term, r._id, r.tf, tuple(r.positions), r.dl) for r in df.collect())
    assert of(index.post) == of(fulltext.postings(docs, fields))
    stats = lambda df: sorted((r.field, r.n_docs, round(r.avg_dl, 9)) for r in df.collect())
    assert stats(index.stats) == stats(fulltext.doc_stats(docs, fields)) == stats(fulltext.field_stats(index.post))


def test_surface_forms_of_other_spellings(spark, tmp_path):
    """Passages whose accents are decomposed or missing, or that spell a letter by two."""
    from sparkloom.queries import ORACLE_SQL, QUERIES
    import duckdb

    texts = ["vor dem caf\u00e9 der gro\u00dfen stra\u00dfe", "vor dem cafe\u0301 der grossen strasse", "VOR DEM CAFE, der Gro\u00dfen Strasse!", "vor der stra\u00dfe"]
    spark.createDataFrame([(i, t, "de", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Dem caf\u00e9 der gro\u00dfen Stra\u00dfe")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["percolate_surface_forms"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["percolate_surface_forms"](spark, str(tmp_path)).select("doc_id", "n").collect()) == want == [(0, 1), (1, 1), (2, 1)]
    assert highlighting.phrases_marked(texts[1], [["cafe", "der"]], 0)[0] == "vor dem <em>cafe\u0301 der</em> grossen strasse"


def test_stream_words_take_only_their_block(spark, tmp_path, monkeypatch):
    """Phrases across the ends of blocks are found, by few words and by many."""
    monkeypatch.setattr(streaming, "BLOCK", 8)
    text = " ".join(f"w{i}" for i in range(100))
    spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "_id string, content string").write.parquet(f"{tmp_path}/in")
    names = spark.createDataFrame([(str(i), "name", f"w{i} w{i + 1} w{i + 2}") for i in range(98)] + [("far", "name", "w1 w9")], "entity_id string, tag string, name string")
    texts = spark.read.parquet(f"{tmp_path}/in")
    for few in (10_000, 0):
        monkeypatch.setattr(streaming, "FEW_TERMS", few)
        found = streaming.percolate_stream(texts, names)
        assert sorted(int(r.entity_id) for r in found.distinct().collect()) == list(range(98))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("filter(ts") >= 2 and (" IN (" in plan or " INSET " in plan) == bool(few)


def test_only_candidates_have_their_postings_met(spark, tmp_path, monkeypatch):
    """Of an index only the postings of documents with a phrase's rarest word meet its slots,
    whether their ids are sent or joined."""
    docs = spark.createDataFrame([("a", "the rare bird of the sea"), ("b", "of the sea the bird"), ("c", "sea of the rare"), ("d", "rare")], "_id string, content string")
    fulltext.save_index(docs, f"{tmp_path}/i", ["content"], 2)
    index = fulltext.load_index(spark, f"{tmp_path}/i", docs, {"content": 1.0})
    names = spark.createDataFrame([("x", "name", "rare bird of the"), ("y", "name", "of the sea"), ("z", "name", "rare")], "entity_id string, tag string, name string")
    for few in (100_000, 0):
        monkeypatch.setattr(phrases, "FEW_IDS", few)
        found = phrases.percolate(names, index, slop=0)
        assert re.search(r"Join LeftSemi, \(_id", found._jdf.queryExecution().optimizedPlan().toString())
        assert sorted((r._id, r.entity_id) for r in found.collect()) == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "y"), ("c", "z"), ("d", "z")]
