"""Facets over the documents that match: values, distinct counts, date histograms, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import predicates as P

METRICS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
INTERVALS = ("year", "quarter", "month", "week", "day", "hour", "minute")


def each_value(docs: DataFrame, field: str, *more: str) -> DataFrame:
    """(key, more...) once for each distinct value of each document."""
    column, kind = P.field_column(docs, field)
    if isinstance(kind, T.ArrayType):
        return docs.select(F.explode(F.array_distinct(column)).alias("key"), *more).where("key is not null")
    return docs.select(column.alias("key"), *more).where("key is not null")


def terms(docs: DataFrame, field: str, size: int | None = 20) -> DataFrame:
    """(key, n): how many documents have each value; most first, then by key. A
    timestamp comes as milliseconds, with its text as ``key_text``."""
    found = each_value(docs, field).groupBy("key").agg(F.count("*").alias("n"))
    if dict(found.dtypes)["key"] == "timestamp":
        found = found.select(F.unix_millis("key").alias("key"), F.date_format("key", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("key_text"), "n")
    ordered = found.orderBy(F.desc("n"), "key")
    return ordered if size is None else ordered.limit(size)


def cardinality(docs: DataFrame, field: str, exact: bool = True) -> DataFrame:
    """(n): distinct values; HyperLogLog++ on request."""
    count = F.count_distinct("key") if exact else F.approx_count_distinct("key", 0.02)
    return each_value(docs, field).agg(count.alias("n"))


def date_histogram(
    docs: DataFrame, field: str, interval: str, low: Column | None = None, high: Column | None = None, metrics: dict[str, list[str]] | None = None
) -> DataFrame:
    """(key, n, metrics...): documents by calendar interval, with empty intervals in
    between, and out to the bounds if these are wider. Metrics are of ``numeric``."""
    if interval not in INTERVALS:
        raise ValueError(f"no interval {interval!r}")
    asked = [(op, m) for op, ms in (metrics or {}).items() for m in ms if op in METRICS]
    values = {m: P.field_column(docs, f"numeric.{m}")[0].alias(f"v_{m}") for _, m in asked}
    column, kind = P.field_column(docs, field)
    at = F.explode(F.array_distinct(F.transform(column, lambda x: F.date_trunc(interval, x)))) if isinstance(kind, T.ArrayType) else F.date_trunc(interval, column)
    rows = docs.select("_id", at.alias("key"), *values.values()).where("key is not null")
    counted = rows.groupBy("key").agg(F.count("*").alias("n"))
    ends = counted.agg(F.min("key").alias("a"), F.max("key").alias("b")).select(
        F.least("a", F.date_trunc(interval, low)).alias("a") if low is not None else F.col("a"),
        F.greatest("b", F.date_trunc(interval, high)).alias("b") if high is not None else F.col("b"),
    )
    step = "interval 3 month" if interval == "quarter" else f"interval 1 {interval}"
    every = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr(step))).alias("key"))
    out = every.join(counted, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
    for m in dict.fromkeys(m for _, m in asked):
        per = rows.select("key", F.explode(f"v_{m}").alias("v")).groupBy("key").agg(*[METRICS[op]("v").alias(f"{m}_{op}") for op, x in asked if x == m])
        out = out.join(per, "key", "left")
    return out


def metrics(docs: DataFrame, asked: dict[str, list[str]]) -> DataFrame:
    """One row with ``<field>_<op>`` of the numbers of a field; every value counts.
    All are made in one pass. Unknown operations are left out."""
    made = []
    for f in dict.fromkeys(f for op, fs in asked.items() if op in METRICS for f in fs):
        values = F.filter(P.field_column(docs, f"numeric.{f}")[0], lambda v: v.isNotNull())
        total = F.sum(F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v)))
        each = {"sum": total, "avg": total / F.sum(F.size(values)), "min": F.min(F.array_min(values)), "max": F.max(F.array_max(values))}
        made += [each[op].alias(f"{f}_{op}") for op, fs in asked.items() if op in METRICS and f in fs]
    return docs.agg(*made) if made else docs.sparkSession.range(1).select()


def filtered(docs: DataFrame, facet: str, tests: dict[str, Column]) -> DataFrame:
    """The documents a facet counts: those that pass the filters of all other facets."""
    return docs.where(P.all_of([t for f, t in tests.items() if f != facet]))
