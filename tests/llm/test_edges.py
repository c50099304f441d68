"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: each operator and stage."""

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import divergence, hilbert, kneser, langid, mixing, neardup, pieces, sketch, urlfilter, warc
from sparkloom.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("node", "sig", "keep__", "language__", "n__", "nll__", "ids__", "text__", "trusted", "r1", "k1", "slot", "block", "c0__", "doc_id__", "h", "root", "copy")
LONG = "the quick brown fox of the hill and " * 40_000
ROWS = [
    (1, "the cat of the house and the dog", "en", "a", 32),
    (1, "the cat of the house and the dog", "en", "a", 32),
    (2, "the cat of the house and the dog", "en", "b", 32),
    (3, None, "en", "a", None),
    (4, "", "en", None, 0),
    (5, " \n\t ", None, "a", 4),
    (6, "12 34 !!", None, None, 8),
    (7, LONG, "en", "a", len(LONG)),
    (8, "x", "fr", "b", 1),
    (None, "der hund und die katze", "de", "b", 22),
    (None, None, None, None, None),
    (9, "日本語 🙂 \x00 ñ", "xx", "c", 9),
]
LABELS = [(1, 1, 0), (7, 1, 0), (8, 1, 1), (8, 1, 0), (None, 1, 0), (2, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    odd = F.struct(F.lit(1).alias("a b"), F.lit("x").alias("c`d")).alias("odd, name")
    return df.select(*df.columns, *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)], odd)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def counted(df, column="doc_id"):
    return sorted((r[0] for r in df.select(column).collect()), key=lambda v: (v is None, v))


def test_language_id(docs, labels, none):
    rows = langid.identify(docs, labels).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r.language for r in rows if r.doc_id is not None}
    assert by_id[3] is by_id[4] is by_id[5] is by_id[6] is None and by_id[1] == "en" and by_id[7] == "en"
    kept = langid.keep(docs, labels)
    assert kept.columns == docs.columns and counted(kept).count(1) == 2
    assert langid.keep(none, labels).collect() == [] and langid.keep(docs, labels.limit(0)).count() == 0


def test_quality_classifier(docs, labels, none):
    kept = kneser.keep(docs, labels)
    ids = counted(kept)
    assert kept.columns == docs.columns
    assert ids.count(1) == 2 and 3 not in ids and 4 not in ids and 8 in ids and 9 in ids
    assert kneser.keep(none, labels).collect() == []
    assert counted(kneser.keep(docs, labels.limit(0))) == [1, 1, 2, 6, 7, 8, 9, None]


def test_divergence(docs, labels, none):
    kept = divergence.keep(docs, labels)
    assert kept.columns == docs.columns and 3 not in counted(kept) and 4 not in counted(kept) and counted(kept).count(1) == 2
    assert divergence.keep(none, labels).collect() == []


def test_near_duplicates(docs, none):
    got = {(r.doc_id, r.keep_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(2, 1)}
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert counted(left) == [1, 3, 4, 5, 6, 7, 8, 9, None, None]
    assert neardup.drop_near_duplicates(none).collect() == [] and neardup.near_duplicates(none).collect() == []


def test_sketches(docs, none):
    rows = sketch.sketches(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r.n_shingles for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert sketch.sketches(none).collect() == [] and sketch.containment(sketch.sketches(none), sketch.sketches(docs)).collect() == []


def test_mixing(docs, none):
    spans = mixing.mixed(docs, block_tokens=50).collect()
    assert {s.doc_id for s in spans} <= {1, 2, 6, 7, 8, 9, None} and len({s.slot for s in spans}) == max(s.slot for s in spans) + 1
    out = mixing.mix(docs, block_tokens=50)
    assert out.columns == docs.columns and set(counted(out)) <= {1, 2, 6, 7, 8, 9, None}
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []


def test_pieces(docs, none):
    rows = pieces.encode(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r.ids for r in rows if r.doc_id is not None}
    assert by_id[3] is None and by_id[4] == []
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect() if r.doc_id is not None}
    assert back == {r[0]: r[1] for r in ROWS if r[0] is not None}
    out = pieces.tokenized(docs)
    assert out.columns == [*docs.columns, "ids"] and out.count() == len(ROWS)
    assert pieces.tokenized(docs.withColumn("ids", F.lit(1))).columns == [*docs.columns, "ids"]
    assert pieces.encode(none).collect() == []


def test_hilbert(docs, none):
    out = hilbert.shards(docs.withColumn("shard", F.lit("clash")), shard_bytes=1000)
    assert out.count() == len(ROWS) and set(docs.columns) < set(out.columns)
    assert hilbert.shards(none).collect() == []


PAGES = [(1, "http://a.example.com/x", "<p>one</p>"), (1, "http://a.example.com/x", "<p>one</p>"), (2, None, None), (3, "", ""), (None, "not a url", "x" * 600_000), (4, "https://[::1]:8080//y", "ü")]


def test_urls_and_bundles(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"bundle": F.lit(1), "verdict": F.lit("clash"), "entry": F.lit(2)})
    said = sorted((r.page_id or 0, r.verdict) for r in urlfilter.classify(pages, [("example.com", "block")]).collect())
    assert said == [(0, "invalid"), (1, "block"), (1, "block"), (2, "invalid"), (3, "invalid"), (4, "none")]
    back = warc.unpack(warc.bundles(pages.coalesce(1))).collect()
    assert sorted(((r.page_id, r.url, r.html) for r in back), key=repr) == sorted(PAGES, key=repr)
    assert warc.bundles(pages.limit(0)).collect() == [] and urlfilter.classify(pages.limit(0)).collect() == []


def test_pipeline_stages(spark, docs, labels, none, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, none):
            out = stage(spark, given, str(tmp_path))
            assert out.columns == [*given.columns, *(["ids"] if name == "tokens" else [])], name
            n = out.count()
            assert n == 0 if given is none else n > 0, name


def test_pipeline_runs(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "mix_sources", "tokens"]
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    given = {r.doc_id for r in table(spark, sf_dir, "documents").select("doc_id").collect()}
    assert 0 < len(rows) and {r.doc_id for r in rows} <= given and all(r.ids for r in rows)
