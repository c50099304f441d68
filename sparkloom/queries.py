"""Every operator applied to the whole test tables, with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model, scratch
from .functions import names as N
from .functions import text as X
from .operators import facets, fulltext, geo, matching, phrases, significant, similar, sorting
from .operators import predicates as P
from .plans.query_string import parse
from .sources import store, transform

SPREAD_BYTES = 256 << 20
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores, and is small enough to
    be moved (``SPREAD_BYTES``), is spread over them by its first column before its
    texts are analysed; a larger one stays as it is read. It is written so, as filters
    on what is analysed would be worked out before the spread too."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scratch.written(df.repartition(cores, df.columns[0]), "spread") if size < SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


# the test tables as documents


def texts(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "text", "lang", "n_chars"))
    return d.select(F.col("doc_id").cast("string").alias("_id"), "doc_id", F.col("source").alias("dataset"), F.lit("PlainText").alias("schema"), F.col("text").alias("content"), "lang", "n_chars")


_indexes: dict[tuple[str, str], str] = {}


def text_index(spark: SparkSession, sf: str) -> fulltext.SearchIndex:
    """The stored index of the documents: analysed once in a session, as a search
    engine does at write, and read by all queries."""
    known = (spark.sparkContext.applicationId, sf)
    if known not in _indexes:
        at = scratch.folder(spark, "index")
        fulltext.save_index(texts(spark, sf), at, ["content"], 16)
        _indexes[known] = at
    return fulltext.load_index(spark, _indexes[known], texts(spark, sf), {"content": 1.0})


def order_docs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("_id"), "o_orderkey", F.lit("Payment").alias("schema"), F.lit("intervals").alias("index_bucket"),
        F.array("o_orderstatus", "o_orderpriority").alias("topics"), F.array("o_orderdate").alias("dates"), F.array(F.concat(F.lit("c"), "o_custkey")).alias("entities"),
        F.create_map(F.lit("amount"), F.array("o_totalprice")).alias("numeric"), "o_orderstatus", "o_orderpriority",
    )


def part_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as companies: a name of words and a brand."""
    p = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"))
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.lit("Company").alias("schema"),
        F.create_map(F.lit("name"), F.array(F.concat_ws(" ", "p_name", "p_brand")), F.lit("sector"), F.array("p_type"), F.lit("amount"), F.array(F.col("p_retailprice").cast("string"))).alias("properties"),
    )


def part_docs(spark: SparkSession, sf: str) -> DataFrame:
    return transform.documents(part_entities(spark, sf), "parts")


# filters


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def term_filter(spark, sf):
    d = table(spark, sf, "customer")
    return d.where(P.field_terms(d, "c_mktsegment", ["BUILDING"])).select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') OR o_orderpriority IN ('F', 'P')")
def terms_filter(spark, sf):
    d = order_docs(spark, sf)
    return d.where(P.field_terms(d, "topics", ["F", "P"])).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice AS amount FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000")
def range_filter(spark, sf):
    d = order_docs(spark, sf)
    return d.where(P.field_range(d, "numeric.amount", {"gte": "100000", "lt": "150000"})).select("o_orderkey", F.col("numeric")["amount"][0].alias("amount"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def date_range_filter(spark, sf):
    d = order_docs(spark, sf)
    return d.where(P.field_range(d, "dates", {"gte": "1996||/y", "lte": "1997||/y"})).select("o_orderkey")


@query("SELECT count(*) FILTER (text IS NOT NULL) AS n_there, count(*) FILTER (text IS NULL) AS n_missing FROM documents")
def exists_missing(spark, sf):
    d = texts(spark, sf)
    there = P.exists(d, "content")
    return d.agg(F.count_if(there).alias("n_there"), F.count_if(~there).alias("n_missing"))


@query("SELECT doc_id FROM documents WHERE lang NOT IN ('en', 'fr')")
def exclude_filter(spark, sf):
    d = texts(spark, sf)
    return d.where(~P.field_terms(d, "lang", ["en", "fr"])).select("doc_id")


@query("SELECT p_partkey FROM part WHERE starts_with(lower(p_name), 'sm')")
def prefix_filter(spark, sf):
    d = table(spark, sf, "part")
    return d.where(P.prefix(d, "p_name", "Sm")).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE doc_id IN (1, 5, 7, 999999999)")
def ids_filter(spark, sf):
    d = texts(spark, sf)
    return d.where(P.field_terms(d, "_id", ["1", "5", "7", "999999999"])).select("doc_id")


@query("SELECT doc_id, source AS dataset FROM documents WHERE source IN ('src1', 'src2')")
def acl_filter(spark, sf):
    return texts(spark, sf).where(P.acl(model.Auth(frozenset(["src1", "src2"])))).select("doc_id", "dataset")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND NOT o_orderpriority IN ('1-URGENT') AND (o_totalprice > 300000 OR o_orderdate < TIMESTAMP '1996-01-01')")
def bool_filter(spark, sf):
    d = order_docs(spark, sf)
    body = {"bool": {
        "must": [{"term": {"o_orderstatus": "O"}}], "must_not": {"terms": {"topics": ["1-URGENT"]}}, "minimum_should_match": 1,
        "should": [{"range": {"numeric.amount": {"gt": 300000}}}, {"range": {"dates": {"lt": "1996"}}}],
    }}
    return d.where(P.from_body(d, body)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus IN ('O', '2-HIGH'))::INT + (o_orderpriority IN ('O', '2-HIGH'))::INT >= 2")
def terms_set_filter(spark, sf):
    d = order_docs(spark, sf)
    return d.where(P.shares(d, "topics", ["O", "2-HIGH"], 2)).select("o_orderkey")


@query("SELECT 'intervals' AS bucket, count(*) AS n FROM orders UNION ALL SELECT 'documents', count(*) FROM documents")
def schema_bucket_pruning(spark, sf):
    both = order_docs(spark, sf).select("schema", "_id").unionByName(texts(spark, sf).select("schema", "_id")).unionByName(table(spark, sf, "part").select(F.lit("Company").alias("schema"), F.col("p_partkey").cast("string").alias("_id")))
    placed = both.withColumn("bucket", transform.schema_column(lambda s: F.lit(s.bucket)))
    return placed.where(F.col("bucket").isin(model.buckets_of(["Payment", "Document"]))).groupBy("bucket").agg(F.count("*").alias("n"))


# facets and metrics


@query("SELECT source AS key, count(*) AS n FROM documents GROUP BY 1")
def facet_terms(spark, sf):
    return facets.terms(texts(spark, sf), "dataset", None)


@query("SELECT key, count(*) AS n FROM (SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS key FROM orders) GROUP BY 1 ORDER BY n DESC, key LIMIT 5")
def facet_terms_multi(spark, sf):
    return facets.terms(order_docs(spark, sf), "topics", 5)


@query("SELECT count(DISTINCT c_nationkey) AS n FROM customer")
def facet_cardinality(spark, sf):
    return facets.cardinality(table(spark, sf, "customer"), "c_nationkey")


@query("""SELECT 'lang' AS facet, lang AS key, count(*) AS n FROM documents WHERE source = 'src3' GROUP BY 2
UNION ALL SELECT 'dataset', source, count(*) FROM documents WHERE lang = 'de' GROUP BY 2""")
def facet_filtered_excl_self(spark, sf):
    d = texts(spark, sf)
    tests = {"lang": P.field_terms(d, "lang", ["de"]), "dataset": P.field_terms(d, "dataset", ["src3"])}
    one = lambda f: facets.terms(facets.filtered(d, f, tests), f, None).select(F.lit(f).alias("facet"), "key", "n")
    return one("lang").unionByName(one("dataset"))


@query("""WITH c AS (SELECT date_trunc('day', ts) AS key, count(*) AS n FROM events WHERE event_type = 'signup' AND value > 90 GROUP BY 1)
SELECT k.key::TIMESTAMP AS key, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(key) FROM c), (SELECT max(key) FROM c), INTERVAL 1 DAY)) AS key) k LEFT JOIN c ON c.key = k.key""")
def facet_date_histogram_fill(spark, sf):
    d = table(spark, sf, "events").withColumn("_id", F.col("event_id").cast("string"))
    rows = d.where((F.col("event_type") == "signup") & (F.col("value") > 90))
    return facets.date_histogram(rows, "ts", "day").select(F.col("key").cast("timestamp_ntz").alias("key"), "n")


@query("""WITH c AS (SELECT date_trunc('month', o_orderdate) AS key, count(*) AS n FROM orders WHERE o_totalprice > 490000 GROUP BY 1)
SELECT k.key::TIMESTAMP AS key, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(least((SELECT min(key) FROM c), TIMESTAMP '1994-01-01'), greatest((SELECT max(key) FROM c), TIMESTAMP '2002-06-01'), INTERVAL 1 MONTH)) AS key) k LEFT JOIN c ON c.key = k.key""")
def facet_histogram_extended_bounds(spark, sf):
    d = order_docs(spark, sf).where(F.col("numeric")["amount"][0] > 490000)
    out = facets.date_histogram(d, "dates", "month", F.lit("1994-01-01").cast("timestamp"), F.lit("2002-06-15").cast("timestamp"))
    return out.select(F.col("key").cast("timestamp_ntz").alias("key"), "n")


@query("""SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS key, count(*) AS n, round(sum(o_totalprice), 2) AS amount_sum, max(o_totalprice) AS amount_max FROM orders GROUP BY 1""")
def facet_histogram_metrics(spark, sf):
    out = facets.date_histogram(order_docs(spark, sf), "dates", "year", metrics={"sum": ["amount"], "max": ["amount"]})
    return out.select(F.col("key").cast("timestamp_ntz").alias("key"), "n", F.round("amount_sum", 2).alias("amount_sum"), "amount_max")


@query("SELECT round(sum(o_totalprice), 2) AS amount_sum, round(avg(o_totalprice), 4) AS amount_avg, min(o_totalprice) AS amount_min, max(o_totalprice) AS amount_max FROM orders")
def metric_sum_avg_min_max(spark, sf):
    m = facets.metrics(order_docs(spark, sf), {op: ["amount"] for op in ("sum", "avg", "min", "max")})
    return m.withColumns({"amount_sum": F.round("amount_sum", 2), "amount_avg": F.round("amount_avg", 4)})


# order, pages, projection


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus DESC, o_orderkey::VARCHAR) AS rank FROM orders
ORDER BY o_orderpriority, o_orderstatus DESC, o_orderkey::VARCHAR LIMIT 50 OFFSET 10""")
def sort_multi_reversed(spark, sf):
    d = order_docs(spark, sf)
    page = sorting.page(d, [("o_orderstatus", "desc"), ("o_orderpriority", "asc")], 10, 50)
    return _ranked(page, 10)


def _ranked(page: DataFrame, offset: int = 0) -> DataFrame:
    """Adds the place of each row of a page (a page is small by definition)."""
    from pyspark.sql import Window as W

    kept = page.select("o_orderkey", F.monotonically_increasing_id().alias("m"))
    return kept.select("o_orderkey", (F.row_number().over(W.orderBy("m")) + offset).cast("bigint").alias("rank"))


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY v DESC NULLS LAST, o_orderkey::VARCHAR) AS rank FROM r ORDER BY v DESC NULLS LAST, o_orderkey::VARCHAR LIMIT 100""")
def sort_nulls_last(spark, sf):
    d = order_docs(spark, sf).withColumn("numeric", F.when(F.col("o_orderstatus") != "P", F.col("numeric")))
    return _ranked(sorting.page(d, [("numeric.amount", "desc")], 0, 100))


@query("SELECT p_partkey AS id, 'Company' AS schema, 'parts' AS dataset, concat_ws(' ', p_name, p_brand) AS caption FROM part")
def projection_dehydrate(spark, sf):
    from .plans.params import from_url
    from .plans.search import EntitiesQuery

    index = fulltext.SearchIndex(part_docs(spark, sf), spark.createDataFrame([], "field string, term string, _id string, tf int, positions array<int>, dl int"))
    q = EntitiesQuery(index, from_url("", "dehydrate=true&filter:schema=Company"))
    return q.project(q.base()).select(F.col("_id").cast("bigint").alias("id"), "schema", "dataset", "caption")


# full text

TOK = f"tok AS (SELECT doc_id, lang, source, {X.words_sql('text')} AS ts FROM documents)"


def _ids(spark, sf, text: str) -> DataFrame:
    return text_index(spark, sf).search(parse(text)).select(F.col("_id").cast("bigint").alias("doc_id"))


@query(f"WITH {TOK} SELECT t AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(ts) AS t FROM tok) GROUP BY 1")
def index_terms(spark, sf):
    """Builds the index anew, and gives its dictionary."""
    _indexes.pop((spark.sparkContext.applicationId, sf), None)
    return text_index(spark, sf).terms.select("term", "df")


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE list_contains(ts, 'the') AND list_contains(ts, 'from')")
def fulltext_and(spark, sf):
    return _ids(spark, sf, "The AND from")


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE list_contains(ts, 'und') OR list_contains(ts, 'idiot')")
def fulltext_or(spark, sf):
    return _ids(spark, sf, "und OR idiot")


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE list_contains(ts, 'the') AND NOT list_contains(ts, 'idiot')")
def fulltext_not(spark, sf):
    return _ids(spark, sf, "the -idiot")


@query(f"WITH {TOK} SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(ts) AS t FROM tok) WHERE regexp_full_match(t, 'thea.*ng')")
def fulltext_wildcard(spark, sf):
    return _ids(spark, sf, "thea*ng")


@query(f"WITH {TOK} SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(ts) AS t FROM tok) WHERE levenshtein(t, 'idiot') <= 1")
def fulltext_fuzzy(spark, sf):
    return _ids(spark, sf, "idiot~")


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE (list_contains(ts, 'der') OR list_contains(ts, 'les')) AND NOT (list_contains(ts, 'moron') OR list_contains(ts, 'und'))")
def fulltext_boolean_group(spark, sf):
    return _ids(spark, sf, "(der OR les) AND NOT (moron OR und)")


_BM25 = """p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM tok) GROUP BY 1, 2),
dl AS (SELECT doc_id, len(ts) AS dl FROM tok WHERE len(ts) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT t, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT p.doc_id, p.t, p.tf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM p JOIN df USING (t) JOIN dl USING (doc_id), st)"""


@query(f"WITH {TOK}, {_BM25} SELECT doc_id, round(sum(score), 6) AS score FROM s WHERE t IN ('idiot', 'the') GROUP BY 1")
def bm25_scores(spark, sf):
    hits = text_index(spark, sf).search(parse("idiot OR the"))
    return hits.select(F.col("_id").cast("bigint").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""WITH {TOK}, {_BM25}, r AS (SELECT doc_id, round(sum(score), 6) AS score FROM s WHERE t IN ('stupid', 'pathetic') GROUP BY 1 HAVING count(*) = 2)
SELECT doc_id, score FROM r ORDER BY score DESC, doc_id::VARCHAR LIMIT 20""")
def bm25_topk(spark, sf):
    hits = text_index(spark, sf).search(parse("stupid pathetic")).withColumn("score", F.round("score", 6))
    return sorting.page(hits, [], 0, 20).select(F.col("_id").cast("bigint").alias("doc_id"), "score")


@query(f"""WITH {TOK}, pos AS (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS p FROM tok)
SELECT DISTINCT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.t = 'of' AND b.t = 'the' AND b.p = a.p + 1""")
def phrase_exact(spark, sf):
    return _ids(spark, sf, '"of the"')


@query(f"""WITH {TOK}, pos AS (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS p FROM tok)
SELECT DISTINCT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.t = 'from' AND b.t = 'with' AND a.p <> b.p AND abs((b.p - 1) - a.p) <= 3""")
def phrase_slop(spark, sf):
    return _ids(spark, sf, '"from with"~3')


@query(
    f"""WITH h AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->|<[^<>]*>', ' ', 'g') AS x FROM pages),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS y FROM h),
w AS (SELECT page_id, {X.words_sql("y")} AS ts FROM u) SELECT page_id, len(ts) AS n, len(list_distinct(ts)) AS n_distinct FROM w"""
)
def html_words(spark, sf):
    ws = X.words(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(ws).alias("n"), F.size(F.array_distinct(ws)).alias("n_distinct"))


@query(f"WITH {TOK} SELECT doc_id, len(ts) AS n, md5(array_to_string(ts, ' ')) AS digest FROM tok")
def analyzed_words(spark, sf):
    ws = X.words(F.col("content"))
    return texts(spark, sf).select("doc_id", F.size(ws).alias("n"), F.md5(F.array_join(ws, " ")).alias("digest"))


# phrases between tables


def _benchmark_names(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("entity_id"), F.lit("name").alias("tag"), F.col("text").alias("name"))


_PASSAGES = f"""WITH {TOK}, d AS (SELECT doc_id, ' ' || array_to_string(ts, ' ') || ' ' AS x FROM tok),
b AS (SELECT item_id, ' ' || array_to_string({X.words_sql('text')}, ' ') || ' ' AS y FROM benchmark)"""


@query(f"{_PASSAGES} SELECT doc_id, item_id FROM d JOIN b ON contains(x, y)")
def percolate_batch(spark, sf):
    hits = phrases.percolate(_benchmark_names(spark, sf), text_index(spark, sf), slop=0)
    return hits.select(F.col("_id").cast("bigint").alias("doc_id"), F.col("entity_id").cast("bigint").alias("item_id"))


@query(f"{_PASSAGES} SELECT doc_id, array_to_string(list_sort(list(item_id::VARCHAR)), ',') AS sources FROM d JOIN b ON contains(x, y) GROUP BY 1")
def mentions_multi(spark, sf):
    hits = phrases.mentions(_benchmark_names(spark, sf), text_index(spark, sf), slop=0, names_col=None)
    return hits.select(F.col("_id").cast("bigint").alias("doc_id"), F.array_join("mention_sources", ",").alias("sources"))


@query(f"""WITH {TOK}, pos AS (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS p FROM tok)
SELECT DISTINCT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.t = 'idiot' AND b.t = 'the' AND abs((b.p - 1) - a.p) <= 2""")
def mentions_one(spark, sf):
    name = spark.createDataFrame([("e", "name", "Idiot the")], "entity_id string, tag string, name string")
    return phrases.mentions(name, text_index(spark, sf), names_col=None).select(F.col("_id").cast("bigint").alias("doc_id"))


# significance, similarity


@query("""WITH fg AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), bg AS (SELECT source AS key, count(*) AS bg FROM documents GROUP BY 1),
f AS (SELECT source AS key, count(*) AS n FROM documents SEMI JOIN fg USING (doc_id) GROUP BY 1),
t AS (SELECT (SELECT count(*) FROM documents SEMI JOIN fg USING (doc_id)) AS nf, (SELECT count(*) FROM documents) AS nb)
SELECT key, n, bg, round((n / nf - bg / nb) * ((n / nf) / (bg / nb)), 6) AS score FROM f JOIN bg USING (key), t WHERE n >= 2 AND n / nf > bg / nb""")
def significant_terms(spark, sf):
    d = texts(spark, sf)
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct()
    out = significant.terms(d.join(toxic, "doc_id", "left_semi"), d, "dataset", None, 2)
    return out.withColumn("score", F.round("score", 6))


@query(f"""WITH {TOK}, fg AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), w AS (SELECT DISTINCT doc_id, unnest(ts) AS key FROM tok),
bg AS (SELECT key, count(*) AS bg FROM w GROUP BY 1), f AS (SELECT key, count(*) AS n FROM w SEMI JOIN fg USING (doc_id) GROUP BY 1),
t AS (SELECT (SELECT count(*) FROM documents SEMI JOIN fg USING (doc_id)) AS nf, (SELECT count(*) FROM documents) AS nb)
SELECT key, n, bg, round((n / nf - bg / nb) * ((n / nf) / (bg / nb)), 6) AS score FROM f JOIN bg USING (key), t WHERE n >= 5 AND n / nf > bg / nb""")
def significant_text(spark, sf):
    d = texts(spark, sf)
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct()
    out = significant.text(d.join(toxic, "doc_id", "left_semi"), text_index(spark, sf), "content", None, 5, distinct_texts=False)
    return out.withColumn("score", F.round("score", 6))


@query(f"""WITH {TOK}, {_BM25}, nn AS (SELECT n FROM st),
src AS (SELECT t, tf * (1 + ln(n / (df + 1))) AS w FROM p JOIN df USING (t), nn WHERE doc_id = 10 AND len(t) >= 5 AND df BETWEEN 1 AND 500),
pick AS (SELECT * FROM src ORDER BY w DESC, t LIMIT 200), need AS (SELECT greatest(1, floor(count(*) * 0.1)) AS need, max(w) AS most FROM pick)
SELECT doc_id, round(sum(score * w / most), 5) AS score, count(*) AS matched FROM s JOIN pick USING (t), need WHERE doc_id <> 10 GROUP BY doc_id, need HAVING count(*) >= need""")
def more_like_this(spark, sf):
    index = text_index(spark, sf)
    out = similar.more_like(index, index.docs.where("_id = '10'"))
    return out.select(F.col("_id").cast("bigint").alias("doc_id"), F.round("score", 5).alias("score"), "matched")


@query()
def more_like_all(spark, sf):
    """Of each document all that are like it: every row is a query."""
    index = text_index(spark, sf)
    out = similar.more_like(index, index.docs)
    return out.select(F.col("source_id").cast("bigint").alias("source_id"), F.col("_id").cast("bigint").alias("doc_id"), F.round("score", 5).alias("score"), "matched")


# names and entities

_NAME = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_PART = _NAME.format("concat_ws(' ', p_name, p_brand)")


@query(f"SELECT p_partkey AS id, {_PART} AS name, array_to_string(list_sort(string_split({_PART}, ' ')), '') AS key FROM part")
def name_keys(spark, sf):
    d = part_docs(spark, sf)
    return d.select(F.col("_id").cast("bigint").alias("id"), F.col("names")[0].alias("name"), F.col("name_keys")[0].alias("key"))


@query(f"SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_filter(string_split({_PART}, ' '), lambda t: len(t) >= 2))), ' ') AS parts FROM part")
def name_parts(spark, sf):
    return part_docs(spark, sf).select(F.col("_id").cast("bigint").alias("id"), F.array_join("name_parts", " ").alias("parts"))


@query()
def name_phonetic(spark, sf):
    return part_docs(spark, sf).select("_id", "name_phonetic")


@query(f"""WITH k AS (SELECT p_partkey AS id, array_to_string(list_sort(string_split({_PART}, ' ')), '') AS key FROM part)
SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.key = y.key AND x.id::VARCHAR < y.id::VARCHAR""")
def blocking_pairs(spark, sf):
    keys_only = part_docs(spark, sf).withColumn("name_phonetic", F.array().cast("array<string>"))
    return matching.blocking_pairs(keys_only).select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))


@query()
def blocking_pairs_all(spark, sf):
    """All pairs that share any key: those of ``blocking_pairs``, and by phonetic codes, symbols and identifiers."""
    return matching.blocking_pairs(part_docs(spark, sf)).select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))


@query()
def match_entity(spark, sf):
    """Of each part all others that match it: every row is a query."""
    d = part_docs(spark, sf)
    return matching.matches(d, d).select("source_id", "_id", F.round("score", 4).alias("score"))


@query("SELECT s_suppkey AS id, s_name AS caption, n_name AS country, 'things' AS bucket, 2 AS num_values FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def entity_documents(spark, sf):
    s = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    props = F.create_map(F.lit("name"), F.array("s_name"), F.lit("country"), F.array("n_name"))
    d = transform.documents(s.select(F.col("s_suppkey").cast("string").alias("id"), F.lit("Organization").alias("schema"), props.alias("properties")), "suppliers")
    return d.select(F.col("_id").cast("bigint").alias("id"), "caption", F.col("countries")[0].alias("country"), F.col("index_bucket").alias("bucket"), "num_values")


_LON, _LAT = "((s_suppkey * 37) % 360 - 180)::DOUBLE", "((s_suppkey * 17) % 170 - 85)::DOUBLE"


def _suppliers(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    point = F.struct((k * 37 % 360 - 180).cast("double").alias("lon"), (k * 17 % 170 - 85).cast("double").alias("lat"))
    return table(spark, sf, "supplier").select(k.cast("string").alias("_id"), F.array(point).alias("geo_point"))


@query(f"""SELECT s_suppkey AS id, round(6371.0087714 * sqrt(power(radians(least(abs({_LON} - 13.4), 360 - abs({_LON} - 13.4))) * cos(radians((52.5 + {_LAT}) / 2)), 2) + power(radians({_LAT} - 52.5), 2)), 3) AS distance_km FROM supplier""")
def geo_nearest(spark, sf):
    return geo.nearest(_suppliers(spark, sf), 13.4, 52.5).select(F.col("_id").cast("bigint").alias("id"), F.round("distance_km", 3).alias("distance_km"))


@query(f"""WITH p AS (SELECT s_suppkey AS id, {_LON} AS lon, {_LAT} AS lat FROM supplier),
d AS (SELECT a.id AS a, b.id AS b, 6371.0087714 * sqrt(power(radians(least(abs(b.lon - a.lon), 360 - abs(b.lon - a.lon))) * cos(radians((a.lat + b.lat) / 2)), 2) + power(radians(b.lat - a.lat), 2)) AS km FROM p a JOIN p b ON a.id <> b.id)
SELECT a, b, round(km, 3) AS distance_km FROM d WHERE km <= 1500""")
def geo_pairs(spark, sf):
    pts = _suppliers(spark, sf).select("_id", F.col("geo_point")[0]["lon"].alias("lon"), F.col("geo_point")[0]["lat"].alias("lat"))
    return geo.nearest_pairs(pts, 1500.0).select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.round("distance_km", 3).alias("distance_km"))


# store


@query("SELECT 'c' || o_custkey AS entity_id, count(*) AS n FROM orders GROUP BY 1")
def adjacency(spark, sf):
    return store.adjacency(order_docs(spark, sf)).groupBy("entity_id").agg(F.count("*").alias("n"))


@query("SELECT md5(text) AS checksum, count(*) AS n FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1) GROUP BY 1 UNION ALL SELECT 'none', 0")
def checksum_counts(spark, sf):
    d = texts(spark, sf).withColumn("checksums", F.array(F.md5("content")))
    twice = d.groupBy(F.md5("content").alias("checksum")).agg(F.count("*").alias("k")).where("k > 1").select("checksum")
    return store.checksum_counts(d, twice.union(spark.createDataFrame([("none",)], "checksum string")))


@query("SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id IN (SELECT page_id FROM pages)")
def cross_bucket_duplicates(spark, sf):
    a = texts(spark, sf).select("_id", F.lit("documents").alias("index_bucket"))
    b = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("_id"), F.lit("pages").alias("index_bucket"))
    return store.cross_bucket_duplicates(a.unionByName(b)).select(F.col("_id").alias("id"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def upsert_latest(spark, sf):
    return store.latest(table(spark, sf, "events"), "user_id", "ts").select("user_id", "event_id")


@query()
def flagship(spark, sf):
    """Free text with a filter: all hits with their scores."""
    from .plans.params import from_url
    from .plans.search import EntitiesQuery

    index = text_index(spark, sf)
    index.docs = index.docs.withColumns({"index_bucket": F.lit("documents"), "num_values": F.lit(1)})
    q = EntitiesQuery(index, from_url("the -idiot", "filter:schema=PlainText&filter:lang=en&facet=dataset"))
    return q.base().select("_id", "dataset", F.round("score", 6).alias("score"))


ORACLE_SQL["flagship"] = f"""WITH {TOK}, {_BM25} SELECT s.doc_id::VARCHAR AS _id, source AS dataset, round(score, 6) AS score
FROM s JOIN tok USING (doc_id) WHERE t = 'the' AND NOT list_contains(ts, 'idiot') AND lang = 'en'"""


from . import request_queries  # noqa: E402, F401  (registers its queries)
