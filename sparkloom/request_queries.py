"""More operators over the whole test tables, with SQL: requests, names, the store, highlights, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import model, scratch, streaming
from .functions import names as N
from .functions import text as X
from .operators import facets, fulltext, highlighting, phrases, significant, sorting
from .operators import predicates as P
from .plans import search as S
from .plans.params import from_url
from .plans.query_string import parse
from .queries import _BM25, _PART, _PASSAGES, TOK, _benchmark_names, order_docs, part_docs, part_entities, query, spread, table, text_index, texts
from .sources import store, transform


def documents(spark, sf) -> fulltext.SearchIndex:
    """The stored index of the texts, with the columns that requests ask for."""
    index = text_index(spark, sf)
    index.docs = index.docs.withColumns({"index_bucket": F.lit("documents"), "num_values": F.lit(1), "topics": F.when(F.col("n_chars") > 2000, F.array(F.lit("long")))})
    return index


def asked(spark, sf, q: str, args: str) -> S.EntitiesQuery:
    return S.EntitiesQuery(documents(spark, sf), from_url(q, args))


def supplier_entities(spark, sf) -> DataFrame:
    s = spread(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")).join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    text = lambda c: F.array(F.col(c).cast("string"))
    k = F.col("s_suppkey")
    props = F.create_map(
        F.lit("name"), text("s_name"), F.lit("country"), text("n_name"), F.lit("registrationNumber"), text("s_suppkey"), F.lit("indexText"), F.array(F.concat(F.lit("__translation__ "), "s_name")),
        F.lit("latitude"), F.array(F.concat((k * 17 % 170 - 85).cast("string"), F.lit(",5"))), F.lit("longitude"), F.array((k * 37 % 360 - 180).cast("string")),
    )
    return s.select(k.cast("string").alias("id"), F.lit("Organization").alias("schema"), props.alias("properties"), F.array(F.lit("x"), F.lit("y")).alias("tags"), "s_nationkey", "s_suppkey")


def new_store(spark, what: str, shards: int = 4) -> store.EntityStore:
    return store.EntityStore(spark, scratch.folder(spark, what), shards)


# requests


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source <> 'src3' AND n_chars >= 500 AND n_chars < 5000 AND n_chars <= 2000")
def request_filters(spark, sf):
    """Filters, ranges, what is excluded, and fields that must be empty."""
    q = asked(spark, sf, "", "filter:schema=PlainText&filter:lang=en&filter:lang=de&exclude:dataset=src3&filter:gte:n_chars=500&filter:lt:n_chars=5000&empty:topics=1")
    return q.base().select("doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id::VARCHAR) AS rank FROM documents WHERE lang <> 'fr' ORDER BY n_chars DESC, doc_id::VARCHAR LIMIT 30 OFFSET 15")
def request_page(spark, sf):
    """A page of a request: order, offset and limit."""
    hits = asked(spark, sf, "", "filter:schema=PlainText&exclude:lang=fr&sort=n_chars:desc&limit=30&offset=15").search().hits
    kept = hits.select("doc_id", F.monotonically_increasing_id().alias("m"))
    return kept.select("doc_id", (F.row_number().over(W.orderBy("m")) + 15).cast("bigint").alias("rank"))  # one page


@query("""SELECT 'lang.values' AS facet, lang AS key, count(*) AS n FROM documents WHERE n_chars > 300 GROUP BY 2
UNION ALL SELECT 'dataset.values', source, count(*) FROM documents WHERE n_chars > 300 AND lang = 'de' GROUP BY 2
UNION ALL SELECT 'total', '', count(*) FROM documents WHERE n_chars > 300 AND lang = 'de'""")
def request_facets(spark, sf):
    """Facets of a request, each without its own filter, and the number of hits."""
    r = asked(spark, sf, "", "filter:schema=PlainText&filter:gt:n_chars=300&facet=lang&facet=dataset&filter:lang=de&facet_size:dataset=100").search()
    out = [r.facets[f].select(F.lit(f).alias("facet"), "key", "n") for f in ("lang.values", "dataset.values")]
    return out[0].unionByName(out[1]).unionByName(r.matches.agg(F.count("*").alias("n")).select(F.lit("total").alias("facet"), F.lit("").alias("key"), "n"))


@query("SELECT DISTINCT p_partkey AS id FROM (SELECT p_partkey, unnest(string_split(lower(p_name) || ' ' || replace(lower(p_brand), '#', ' '), ' ')) AS w FROM part) WHERE starts_with(w, 'sm')")
def request_prefix(spark, sf):
    d = part_docs(spark, sf)
    return S.EntitiesQuery(fulltext.SearchIndex(d, fields={"name": 1.0}), from_url("", "prefix=Sm")).base().select(F.col("_id").cast("bigint").alias("id"))


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def request_access(spark, sf):
    """What a person may read limits every request."""
    q = S.EntitiesQuery(documents(spark, sf), from_url("", "filter:schema=PlainText&filter:lang=en", model.Auth(frozenset(["src1", "src2", "none"]))))
    return q.base().select("doc_id")


@query(f"""WITH {TOK} SELECT tok.doc_id FROM tok JOIN documents USING (doc_id)
WHERE tok.lang = 'en' AND list_contains(ts, 'the') AND NOT list_contains(ts, 'idiot') AND (n_chars > 1000 OR list_contains(ts, 'was'))""")
def body_with_texts(spark, sf):
    """A query tree with texts at several places of it."""
    body = {"query": {"bool": {
        "must": [{"match": {"content": "the"}}, {"bool": {"should": [{"range": {"n_chars": {"gt": 1000}}}, {"match": {"content": "was"}}]}}],
        "must_not": [{"match": {"content": "idiot"}}], "filter": {"term": {"lang": "en"}},
    }}}
    return S.search_body(documents(spark, sf), body).matches.select("doc_id")


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE list_contains(ts, 'idiot') OR list_contains(ts, 'moron')")
def synonyms_expand(spark, sf):
    rules = fulltext.synonym_groups(["idiot, moron", "other, another"])
    return text_index(spark, sf).search(parse("idiot"), rules).select(F.col("_id").cast("bigint").alias("doc_id"))


@query(f"""WITH {TOK}, {_BM25} SELECT s.doc_id, round(score + sqrt(0.5 * n_chars), 5) AS score FROM s JOIN documents USING (doc_id) WHERE t = 'from'""")
def function_score(spark, sf):
    """Scores with the bonus of a document's number of values (here: of characters)."""
    d = documents(spark, sf)
    rows = d.docs.withColumn("num_values", F.col("n_chars")).join(d.search(parse("from")), "_id")
    return rows.select("doc_id", F.round(S.boosted(F.col("score"), rows), 5).alias("score"))


_FIELDS = f"""n AS (SELECT p_partkey AS id, regexp_extract_all(lower(p_name || ' ' || p_brand), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS ts, {_PART} AS whole FROM part),
nt AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(ts) AS t FROM n) GROUP BY 1, 2),
ns AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM n), nd AS (SELECT t, count(*) AS df FROM nt GROUP BY 1),
nscore AS (SELECT id, 4 * ln(1 + (ns.n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.75 + 0.25 * len(ts) / avgdl)) AS score FROM nt JOIN nd USING (t) JOIN n USING (id), ns WHERE t = 'small'),
pt AS (SELECT DISTINCT id, unnest(list_filter(string_split(whole, ' '), lambda x: len(x) >= 2)) AS t FROM n),
pscore AS (SELECT id, 2 * ln(1 + ((SELECT count(DISTINCT id) FROM pt) - (SELECT count(*) FROM pt WHERE t = 'small') + 0.5) / ((SELECT count(*) FROM pt WHERE t = 'small') + 0.5)) / 2.2 AS score FROM pt WHERE t = 'small')"""


@query(f"WITH {_FIELDS} SELECT id, round(max(score), 5) AS score FROM (SELECT * FROM nscore UNION ALL SELECT * FROM pscore) GROUP BY 1")
def bm25_multifield(spark, sf):
    """The best of several fields, each with its weight: words of the name, whole names, parts of names."""
    index = fulltext.SearchIndex(part_docs(spark, sf), fields={f: w for f, w in fulltext.FIELDS.items() if f in ("name", "names", "name_parts")})
    return index.search(parse("small")).select(F.col("_id").cast("bigint").alias("id"), F.round("score", 5).alias("score"))


@query(f"SELECT p_partkey AS id FROM part WHERE array_to_string(list_sort(string_split({_PART}, ' ')), '') IN ('17brandredwidget', '4blueboltbrand', 'blueboltbrand', 'brandredwidget', '17redwidget')")
def name_key_expansion(spark, sf):
    """Documents whose name key is that of two to four words of the query."""
    index = fulltext.SearchIndex(part_docs(spark, sf), fields={"names": 1.0})
    q = S.EntitiesQuery(index, from_url("red widget brand 17", "synonyms=true"))
    r = S.EntitiesQuery(index, from_url("blue bolt brand 4", "synonyms=true"))
    return q.base().select("_id").union(r.base().select("_id")).distinct().select(F.col("_id").cast("bigint").alias("id"))


# highlights


@query(f"WITH {TOK} SELECT doc_id, true AS marked FROM tok WHERE list_contains(ts, 'idiot') OR list_contains(ts, 'pathetic')")
def highlight_passages(spark, sf):
    """Of each hit whether it has passages and all of them are marked, with its own words only."""
    index, node = documents(spark, sf), parse("idiot OR pathetic")
    hits = index.docs.join(index.search(node), "_id")
    out = highlighting.highlight(hits, node)
    found = F.try_element_at("highlight", F.lit("content"))
    bare = F.regexp_replace(F.concat_ws(" ", F.flatten(F.transform(found, lambda p: F.regexp_extract_all(p, F.lit("(?s)<em>(.*?)</em>"), F.lit(1))))), r"(?i)idiot|pathetic| ", "")
    return out.select("doc_id", ((F.size(found) > 0) & F.forall(found, lambda p: p.contains("<em>")) & (bare == "")).alias("marked"))


@query(f"""{_PASSAGES} SELECT doc_id, count(*) AS n FROM d JOIN b ON contains(x, y) GROUP BY 1""")
def percolate_surface_forms(spark, sf):
    """Of each document the number of passages it mentions, of which the marked place has all the words."""
    index = text_index(spark, sf)
    hits = phrases.percolate(_benchmark_names(spark, sf), index, slop=0).select("_id", "entity_id", F.explode("fired").alias("name"))
    rows = hits.join(index.docs.select(F.col("_id"), "content"), "_id").withColumn("fired", F.array("name"))
    keyed = rows.select(F.concat_ws("/", "_id", "entity_id", F.md5("name")).alias("_id"), F.col("_id").alias("doc"), "content", "fired", "name")
    out = highlighting.phrase_passages(keyed, "fired", slop=0)
    same = F.exists("surface_forms", lambda f: X.words(f) == X.words(F.col("name")))  # by words, as the place may be written otherwise
    return out.where(same).groupBy(F.col("doc").cast("bigint").alias("doc_id")).agg(F.count("*").alias("n"))


@query(f"""{_PASSAGES}, pos AS (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS p FROM tok)
SELECT DISTINCT a.doc_id, 'e1' AS source FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.t = 'of' AND b.t = 'idiot' AND abs((b.p - 1) - a.p) <= 2
UNION SELECT DISTINCT a.doc_id, 'e2' FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.t = 'moron' AND b.t = 'the' AND abs((b.p - 1) - a.p) <= 2""")
def mentions_slop(spark, sf):
    """Two names with the usual slop, and which of them each document mentions."""
    names = spark.createDataFrame([("e1", "name", "of idiot"), ("e2", "name", "Moron the")], "entity_id string, tag string, name string")
    out = phrases.mentions(names, text_index(spark, sf), names_col=None)
    return out.select(F.col("_id").cast("bigint").alias("doc_id"), F.explode("mention_sources").alias("source"))


# aggregates


@query("SELECT epoch_ms(date_trunc('day', ts)) AS key, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS key_text, count(*) AS n FROM events GROUP BY 1, 2")
def facet_date_terms(spark, sf):
    """Values of a time come as milliseconds and as text."""
    d = table(spark, sf, "events").select(F.col("event_id").alias("_id"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"))
    return facets.terms(d, "day", None)


@query("""WITH v AS (SELECT o_orderkey AS id, o_totalprice > 300000 AS f, unnest([o_orderstatus, o_orderpriority]) AS key FROM orders),
bg AS (SELECT key, count(*) AS bg FROM v GROUP BY 1), t AS (SELECT count(*) FILTER (o_totalprice > 300000) AS nf, count(*) AS nb FROM orders),
fg AS (SELECT key, count(*) AS n FROM v WHERE f GROUP BY 1),
top AS (SELECT key AS outer_key FROM fg JOIN bg USING (key), t WHERE n >= 5 AND n / nf > bg / nb ORDER BY (n / nf - bg / nb) * ((n / nf) / (bg / nb)) DESC, key LIMIT 20),
ins AS (SELECT outer_key, id FROM top JOIN v ON v.key = outer_key WHERE f), tot AS (SELECT outer_key, count(*) AS no FROM ins GROUP BY 1),
pairs AS (SELECT outer_key, v.key, count(*) AS n FROM ins JOIN v USING (id) WHERE v.key <> outer_key GROUP BY 1, 2)
SELECT outer_key AS "outer", key, n, bg, round((n / no - bg / nb) * ((n / no) / (bg / nb)), 6) AS score FROM pairs JOIN tot USING (outer_key) JOIN bg USING (key), t WHERE n >= 5 AND n / no > bg / nb""")
def significant_nested(spark, sf):
    """Significant values, and within each of them those that go with it."""
    d = order_docs(spark, sf)
    out = significant.nested(d.where(F.col("numeric")["amount"][0] > 300000), d, "topics")
    return out.withColumn("score", F.round("score", 6))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id::VARCHAR) AS k FROM documents) WHERE k <= 3")
def sampler_diversified(spark, sf):
    """The best three of each dataset: the sampler of significant text."""
    return significant.sample(texts(spark, sf).withColumn("score", F.col("n_chars").cast("double")), "diversified", 3).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id::VARCHAR LIMIT 40")
def sampler_top(spark, sf):
    return significant.sample(texts(spark, sf).withColumn("score", F.col("n_chars").cast("double")), "top", 40).select("doc_id")


@query("SELECT o_orderkey, o_orderdate::TIMESTAMP AS day FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate, o_orderkey::VARCHAR LIMIT 25")
def sort_multi_valued(spark, sf):
    """Dates in ascending order, by the least of several."""
    d = order_docs(spark, sf).where(P.field_terms(order_docs(spark, sf), "topics", ["1-URGENT"]))
    d = d.withColumn("when", F.array(F.col("dates")[0], F.timestamp_add("DAY", F.lit(9), F.col("dates")[0])))
    return sorting.page(d, [("when", "asc")], 0, 25).select("o_orderkey", F.col("when")[0].cast("timestamp_ntz").alias("day"))


# names and entities


@query(f"""SELECT p_partkey AS id, CASE WHEN len(list_filter(string_split(trim(regexp_replace(n, '\\s+', ' ', 'g')), ' '), lambda t: len(t) >= 3)) > 0 AND len(string_split(n, ' ')) > 1 THEN n END AS name
FROM (SELECT p_partkey, p_name || ' ' || p_brand AS n FROM part)""")
def clean_names(spark, sf):
    """Names that are worth looking for in texts."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.concat_ws(" ", "p_name", "p_brand"), F.lit(" ")).alias("names"))
    return p.select("id", F.get(N.clean_names_column(F.col("names")), F.lit(0)).alias("name"))


@query("""SELECT s_suppkey AS id, 'LegalEntity Organization Thing' AS schemata, 2 AS n_tags, (s_suppkey * 17 % 170 - 85)::VARCHAR || '.5' AS lat, (s_suppkey * 37 % 360 - 180)::DOUBLE AS lon,
s_suppkey::VARCHAR AS identifier, list_sort(string_split(trim(regexp_replace(lower(s_name), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '))[1] AS word FROM supplier""")
def entity_fields(spark, sf):
    """What an entity's document has of ancestors, translations, points, identifiers and names."""
    d = transform.documents(supplier_entities(spark, sf), "suppliers")
    first = F.array_sort(F.split(F.col("names")[0], " "))[0]
    return d.select(
        F.col("_id").cast("bigint").alias("id"), F.array_join(F.array_sort("schemata"), " ").alias("schemata"), F.size("tags").alias("n_tags"),
        F.format_string("%.1f", F.col("geo_point")[0]["lat"]).alias("lat"), F.col("geo_point")[0]["lon"].alias("lon"), F.col("identifiers")[0].alias("identifier"), first.alias("word"),
    )



@query(f"SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split({_PART}, ' '), lambda t: CASE t WHEN 'red' THEN 'S1' WHEN 'blue' THEN 'S2' WHEN 'brand' THEN 'S3' END), lambda s: s IS NOT NULL))), ' ') AS symbols FROM part")
def name_symbols(spark, sf):
    d = transform.documents(part_entities(spark, sf), "parts", symbols={"red": "S1", "blue": "S2", "brand": "S3"})
    return d.select(F.col("_id").cast("bigint").alias("id"), F.array_join(F.array_sort("name_symbols"), " ").alias("symbols"))


@query("SELECT p_partkey AS id, p_partkey::VARCHAR || '.' || sha1('parts:' || p_partkey) AS signed FROM part")
def signed_ids(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("k")).select("id", transform.signed_id("k", "parts").alias("signed"))


@query(f"""WITH k AS (SELECT p_partkey AS id, list_sort(string_split({_PART}, ' ')) AS ts FROM part)
SELECT x.id AS source, count(*) AS n FROM k x JOIN k y ON x.ts = y.ts AND x.id <> y.id GROUP BY 1""")
def blocking_counts(spark, sf):
    """Of each part how many others share its name key: groups are counted, no pair is made."""
    keys = scratch.written(part_docs(spark, sf).select("_id", F.explode("name_keys").alias("key")), "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    return keys.join(sizes, "key").select(F.col("_id").cast("bigint").alias("source"), (F.col("m") - 1).alias("n"))


@query("SELECT p_partkey AS id, p_name || ' ' || p_brand AS name FROM part")
def projection_include_fields(spark, sf):
    """Without properties, but for a group that is asked for."""
    index = fulltext.SearchIndex(part_docs(spark, sf), spark.createDataFrame([], "field string, term string, _id string, tf int, positions array<int>, dl int"))
    q = S.EntitiesQuery(index, from_url("", "dehydrate=true&include_fields=names&filter:schema=Company"))
    hits = q.project(q.base())
    return hits.where(F.size("properties") == 1).select(F.col("_id").cast("bigint").alias("id"), F.col("properties")["name"][0].alias("name"))


# store


@query("""SELECT s_suppkey AS id, CASE WHEN s_nationkey < 10 THEN 'second' ELSE 'first' END AS dataset, s_name AS caption, CASE WHEN s_nationkey < 10 THEN 3 ELSE 2 END AS seq
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name <> 'NATION_3'""")
def store_upsert_roundtrip(spark, sf):
    """Entities are written, some again for another dataset, and those of a country deleted by query."""
    s = new_store(spark, "store")
    e = supplier_entities(spark, sf)
    s.create(transform.documents(e))
    s.index("first", e)
    s.index("second", e.where("s_nationkey < 10"))
    s.delete(P.field_terms(s.read(), "countries", ["NATION_3"]))
    return s.read().select(F.col("_id").cast("bigint").alias("id"), "dataset", "caption", F.col("seq").cast("int").alias("seq"))



@query("SELECT s_suppkey AS id, s_name AS caption, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def store_actions_roundtrip(spark, sf):
    """Export as actions, and a second store made of them."""
    one, two = new_store(spark, "one"), new_store(spark, "two")
    one.index("suppliers", supplier_entities(spark, sf))
    at = scratch.folder(spark, "actions")
    one.export_actions(at, hidden_columns=True, records=1000)
    two.upsert(store.read_actions(spark, at, one.read().drop("seq").schema))
    return two.read().select(F.col("_id").cast("bigint").alias("id"), "caption", F.col("countries")[0].alias("country"))


@query("SELECT p_partkey AS id, concat_ws(' ', p_name, p_brand) AS caption, p_retailprice AS amount FROM part")
def store_entities_roundtrip(spark, sf):
    """Stored documents as entities in JSON lines of bounded files, read and written again."""
    one, two = new_store(spark, "one"), new_store(spark, "two")
    one.index("parts", part_entities(spark, sf))
    at = scratch.folder(spark, "entities")
    one.write_entities(at, 500)
    two.index("parts", store.read_entities(spark, at))
    return two.read().select(F.col("_id").cast("bigint").alias("id"), "caption", F.col("numeric")["amount"][0].alias("amount"))


@query("SELECT s_suppkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name NOT IN ('NATION_3', 'NATION_5')")
def store_delete_ids(spark, sf):
    """All ids of two countries are deleted; only the shards that hold them are written."""
    s = new_store(spark, "store", 16)
    s.index("suppliers", supplier_entities(spark, sf))
    gone = [r._id for r in s.scan(filters={"countries": ["NATION_3", "NATION_5"]}, columns=["_id"]).collect()]
    s.delete_ids(gone)
    return s.read().select(F.col("_id").cast("bigint").alias("id"))


@query("""SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey::VARCHAR DESC) AS rank FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7'""")
def store_scan(spark, sf):
    """A scan by access, class and filter, in order of id."""
    s = new_store(spark, "store")
    s.index("suppliers", supplier_entities(spark, sf))
    s.index("parts", part_entities(spark, sf).withColumn("id", F.concat(F.lit("p"), "id")))
    rows = s.scan(model.Auth(frozenset(["suppliers"])), schemata=["Organization"], filters={"countries": ["NATION_7"]}, columns=["_id"], sort="_id:desc")
    numbered = rows.select("_id", F.monotonically_increasing_id().alias("m"))
    return numbered.select(F.col("_id").cast("bigint").alias("id"), F.row_number().over(W.orderBy("m")).cast("bigint").alias("rank"))


@query("SELECT p_partkey AS id, p_type AS sector FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def store_by_ids(spark, sf):
    """Documents of many ids at once."""
    s = new_store(spark, "store")
    s.index("parts", part_entities(spark, sf))
    ids = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").cast("string").alias("_id"))
    return s.by_ids(ids).select(F.col("_id").cast("bigint").alias("id"), F.col("properties")["sector"][0].alias("sector"))


@query("SELECT 'things' AS bucket, count(*) + 1 AS n FROM supplier UNION ALL SELECT 'intervals', 0 WHERE false")
def store_buckets(spark, sf):
    """Only the files of a class's buckets are read: of things here, with one put by itself."""
    s = new_store(spark, "store")
    s.index("suppliers", supplier_entities(spark, sf))
    pay = spread(table(spark, sf, "orders").select("o_orderkey", "o_totalprice")).select(F.col("o_orderkey").cast("string").alias("id"), F.lit("Payment").alias("schema"), F.create_map(F.lit("amount"), F.array(F.col("o_totalprice").cast("string"))).alias("properties"))
    s.index("orders", pay.withColumn("id", F.concat(F.lit("o"), "id")))
    s.put({"id": "one more", "schema": "Person", "properties": {"name": ["One More"]}}, "people")
    return s.read(["Organization", "Person"]).groupBy(F.col("index_bucket").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text <> ''")
def store_content(spark, sf):
    """The whole text of every stored document."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("PlainText").alias("schema"), F.create_map(F.lit("bodyText"), F.array("text")).alias("properties"))
    s = new_store(spark, "store")
    s.index("documents", d)
    return s.read().select(F.col("_id").cast("bigint").alias("doc_id"), F.md5(store.fulltext()).alias("digest")).where("digest is not null")


@query(f"WITH {TOK} SELECT count(*) AS n FROM tok WHERE list_contains(ts, 'from') AND list_contains(ts, 'was')")
def store_search(spark, sf):
    """Search in a store, by the text index of its version."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("PlainText").alias("schema"), F.create_map(F.lit("bodyText"), F.array("text")).alias("properties"))
    s = new_store(spark, "store")
    s.index("documents", d)
    return s.search_index(16).search(parse("content:from AND content:was")).agg(F.count("*").alias("n"))


# streams


@query("SELECT p_partkey AS id, concat_ws(' ', p_name, p_brand) AS caption FROM part")
def stream_ingest(spark, sf):
    """Entities as JSON lines that a stream upserts by micro-batches."""
    at, s = scratch.folder(spark, "in"), new_store(spark, "store")
    part_entities(spark, sf).repartition(3).write.json(at)
    stream = streaming.entity_stream(spark, at, 2)
    streaming.ingest(stream, s, "parts", scratch.folder(spark, "checkpoint")).awaitTermination()
    return s.read().select(F.col("_id").cast("bigint").alias("id"), "caption")


def _streamed(spark, sf, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")


def _drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives of all there is now, by a file sink."""
    at = scratch.folder(df.sparkSession, "out")
    schema = df.schema
    df.writeStream.format("parquet").outputMode(mode).option("path", at).option("checkpointLocation", scratch.folder(df.sparkSession, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(schema).parquet(at)


@query(f"{_PASSAGES} SELECT doc_id, item_id FROM d JOIN b ON contains(x, y)")
def stream_percolate(spark, sf):
    """Percolation of documents that arrive as a stream."""
    live = _streamed(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("_id"), F.col("text").alias("content"))
    hits = _drained(streaming.percolate_stream(live, _benchmark_names(spark, sf), slop=0))
    return hits.select(F.col("_id").cast("bigint").alias("doc_id"), F.col("entity_id").cast("bigint").alias("item_id")).distinct()


@query("""SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def stream_event_counts(spark, sf):
    """Windows of a stream that the watermark has closed."""
    live = _streamed(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drained(streaming.event_counts(live))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
