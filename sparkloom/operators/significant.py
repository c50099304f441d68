"""Values and words that are more frequent among the matches than in the background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..settings import SETTINGS
from .facets import each_value
from .fulltext import SearchIndex


def jlh(fg: Column, n_fg: Column, bg: Column, n_bg: Column) -> Column:
    """(fg% - bg%) * fg% / bg%, null unless positive."""
    a, b = fg / n_fg, bg / n_bg
    return F.when(a > b, (a - b) * (a / b))


def sample(docs: DataFrame, how: str, size: int, share: float = SETTINGS.significant_sample_share, by: str = "dataset") -> DataFrame:
    """A sample of matches: ``none`` all; ``random`` a share by a hash of the id;
    ``top`` those of the best scores; ``diversified`` of each dataset as many."""
    if how == "random":
        return docs.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    if how == "top":
        return docs.orderBy(F.desc("score"), "_id").limit(size)
    if how == "diversified":
        w = W.partitionBy(by).orderBy(F.desc("score"), "_id")
        return docs.withColumn("k__", F.row_number().over(w)).where(F.col("k__") <= size).drop("k__")
    if how != "none":
        raise ValueError(f"no sampler {how!r}")
    return docs


def _scored(fg: DataFrame, bg: DataFrame, n_fg: DataFrame, n_bg: DataFrame, least: int) -> DataFrame:
    """fg and bg: (key, n)."""
    totals = n_fg.select(F.col("n").alias("n_fg")).join(n_bg.select(F.col("n").alias("n_bg")))  # one row each
    joined = fg.where(F.col("n") >= least).join(bg.select("key", F.col("n").alias("bg")), "key").join(F.broadcast(totals))
    return joined.select("key", "n", "bg", jlh(F.col("n"), F.col("n_fg"), F.col("bg"), F.col("n_bg")).alias("score")).where("score is not null")


def _count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"))


def terms(matches: DataFrame, background: DataFrame, field: str, size: int | None = 20, min_doc_count: int | None = None) -> DataFrame:
    """(key, n, bg, score): values of the field, most significant first. The matches
    are part of the background."""
    least = SETTINGS.significant_min_doc_count if min_doc_count is None else min_doc_count
    count = lambda d: each_value(d, field).groupBy("key").agg(F.count("*").alias("n"))
    out = _scored(count(matches), count(background), _count(matches), _count(background), least).orderBy(F.desc("score"), "key")
    return out if size is None else out.limit(size)


def nested(matches: DataFrame, background: DataFrame, field: str, size: int = 20, min_doc_count: int | None = None) -> DataFrame:
    """(outer, key, n, bg, score): for each significant value, those among the
    matches that have it. All pairs come from one self-join on the document."""
    least = SETTINGS.significant_min_doc_count if min_doc_count is None else min_doc_count
    top = terms(matches, background, field, size, least).select(F.col("key").alias("outer"))
    values = each_value(matches, field, "_id")
    inside = values.join(F.broadcast(top), F.col("key") == F.col("outer")).select("outer", "_id")  # at most ``size`` rows
    totals = inside.groupBy("outer").agg(F.count("*").alias("n_fg"))
    pairs = inside.join(values, "_id").groupBy("outer", "key").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("outer") != F.col("key")))
    bg = each_value(background, field).groupBy("key").agg(F.count("*").alias("bg"))
    scored = (
        pairs.join(bg, "key").join(totals, "outer").join(F.broadcast(_count(background).select(F.col("n").alias("n_bg"))))
        .select("outer", "key", "n", "bg", jlh(F.col("n"), F.col("n_fg"), F.col("bg"), F.col("n_bg")).alias("score"))
        .where("score is not null")
    )
    w = W.partitionBy("outer").orderBy(F.desc("score"), "key")
    return scored.withColumn("k__", F.row_number().over(w)).where(F.col("k__") <= size).drop("k__")


def text(
    matches: DataFrame, background: DataFrame | SearchIndex, field: str = "content", size: int | None = 5, min_doc_count: int = 5, distinct_texts: bool = True
) -> DataFrame:
    """(key, n, bg, score): words of a text field, most significant first. Texts of
    the matches that are equal word by word count once, on request. Of an index as
    the background the dictionary is read, and no text."""

    def words(d: DataFrame) -> DataFrame:
        column = F.array_join(field, " ") if d.schema[field].dataType.typeName() == "array" else F.col(field)
        return d.select("_id", F.array_distinct(X.words(column)).alias("ws"), F.xxhash64(X.words(column)).alias("h"))

    fg_rows = words(matches)
    if distinct_texts:
        fg_rows = fg_rows.dropDuplicates(["h"])
    count = lambda d: d.select(F.explode("ws").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    if not isinstance(background, SearchIndex):
        bg, n_bg = count(words(background)), _count(background)
    elif background.terms is None:
        bg, n_bg = count(words(background.docs)), _count(background.docs)
    else:
        bg, n_bg = background.terms.where(F.col("field") == field).select(F.col("term").alias("key"), F.col("df").alias("n")), _count(background.docs)
    out = _scored(count(fg_rows), bg, _count(fg_rows), n_bg, min_doc_count).orderBy(F.desc("score"), "key")
    return out if size is None else out.limit(size)
