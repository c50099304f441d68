"""Threshold-scaled sketches: every shingle hash below a fixed fraction is kept.

Whether a hash is kept depends on nothing but the hash, so the sketch of a union
is the union of the sketches, and |A & B| / |A| of two sketches estimates the
containment of the texts however unequal they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .common import cut, pick, table, widened

WIDTH, SCALE = 5, 16
#: A text whose sketch has fewer hashes than TINY is looked up by all its shingles.
#: Up to SENT of their hashes are sent to the executors; more are joined.
TINY, SENT = 8, 4_000_000
#: Searches take every EVERY-th document by id; an item is held by at least SHARE of its shingles.
EVERY, SHARE = 50, 0.5
HELD = "array<struct<item_id: bigint, shared: bigint, in_doc: double>>"


def _distinct(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 63-bit hashes of each text, in order, and the row of each."""
    hashes, starts = V.shingles_of(part.column("text"), width)
    of = np.repeat(np.arange(part.num_rows), np.diff(starts))
    order = np.lexsort((hashes, of))
    hashes, of = (hashes[order] >> V.U64(1)).astype(np.int64), of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], of[new]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(doc_id, n_shingles, sketch): the number of distinct shingles of ``width``
    words, and in order those of their 63-bit hashes that are below 2^63 / scale.

    One row for each row that comes in, in one pass without a shuffle. A text that
    is null, empty or without a word has 0 shingles and an empty sketch; one of
    fewer than ``width`` words has one shingle of all of them. A repeated shingle
    counts once. Other columns are left out, whatever their names."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    limit = (1 << 63) // scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "text"):
                hashes, of = _distinct(part, width)
                count = np.bincount(of, minlength=part.num_rows).astype(np.int64)
                new = hashes < limit
                offsets = np.zeros(part.num_rows + 1, np.int32)
                np.cumsum(np.bincount(of[new], minlength=part.num_rows), out=offsets[1:])
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[new]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(count), made], names=["doc_id", "n_shingles", "sketch"]
                )

    return rows.mapInArrow(run, widened(rows.drop("text"), n_shingles="long", sketch="array<long>"))


def merged(sketched: DataFrame, by: str) -> DataFrame:
    """(by, sketch) of the texts of each group together: the union of their
    sketches. Null is a group of its own; a null sketch counts as empty."""
    hashes = sketched.select(F.col(by).alias("by"), F.explode_outer("sketch").alias("h")).distinct()
    return hashes.groupBy("by").agg(F.array_sort(F.collect_list("h")).alias("sketch")).withColumnRenamed("by", by)


def containment(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(a_id, b_id, shared, in_b): for each sketch of ``a`` and of ``b`` with a
    common hash, how many they share, and that over the size of a's: the share of
    a's shingles that b is estimated to hold. Joined on the hash, no pair is left
    out; a sketch that is null or empty has no partner."""
    left = a.select(F.col(id_col).alias("a_id"), F.size("sketch").alias("n"), F.explode("sketch").alias("h"))
    right = b.select(F.col(id_col).alias("b_id"), F.explode("sketch").alias("h"))
    return (
        left.join(right, "h")
        .groupBy("a_id", "b_id")
        .agg(F.count("*").alias("shared"), (F.count("*") / F.first("n")).alias("in_b"))
    )


def searched(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, scale: int = SCALE, tiny: int = TINY, sent: int = SENT, every: int = EVERY
) -> DataFrame:
    """(a_id, b_id, shared, in_b, exact): containment of each document whose id is
    divisible by ``every`` in each other document; ids are taken to be unique.
    Where a's sketch has fewer than ``tiny`` hashes, an empty one too, all shingles of
    a are looked up in all of b, so that the share is exact. No pair with a common
    hash is left out."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind, limit = rows.schema["doc_id"].dataType, (1 << 63) // scale
    named = lambda name: T.StructField(name, kind)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "text"):
                hashes, of = _distinct(part, width)
                kept = np.bincount(of[hashes < limit], minlength=part.num_rows)
                few = (kept < tiny)[of]
                use = few | (hashes < limit)
                n = np.where(few, np.bincount(of, minlength=part.num_rows)[of], kept[of])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(of[use])), pa.array(n[use]), pa.array(few[use]), pa.array(hashes[use])], names=["a_id", "n", "exact", "h"]
                )

    queries = rows.where(F.pmod(F.col("doc_id").cast("bigint"), F.lit(every)) == 0)
    left = cut(queries.mapInArrow(asked, T.StructType([named("a_id"), T.StructField("n", T.LongType()), T.StructField("exact", T.BooleanType()), T.StructField("h", T.LongType())])), "asked")
    known = _sent(left, sent)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "text"):
                hashes, of = _distinct(part, width)
                if known is not None:
                    hit = _among(hashes, known.value)
                    hashes, of = hashes[hit], of[hit]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), pa.array(hashes)], names=["b_id", "h"])

    right = rows.mapInArrow(found, T.StructType([named("b_id"), T.StructField("h", T.LongType())]))
    met = left.join(right, "h").where("a_id <> b_id").groupBy("a_id", "b_id")
    return met.agg(F.count("*").alias("shared"), (F.count("*") / F.first("n")).alias("in_b"), F.first("exact").alias("exact"))


def _sent(hashed: DataFrame, sent: int):
    """The distinct hashes ``h`` in order, sent to the executors; None if there are more rows."""
    if hashed.limit(sent + 1).count() > sent:
        return None
    return hashed.sparkSession.sparkContext.broadcast(np.sort(hashed.select("h").distinct().toArrow().column("h").to_numpy()))


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.append(known, -1)[np.searchsorted(known, hashes)] == hashes


def fingerprints(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WIDTH, scale: int = SCALE, share: float = SHARE, sent: int = SENT,
) -> DataFrame:
    """(doc_id, n_shingles, sketch, held): ``sketches`` of every row, and which items (a
    table of texts) the document holds by ``share`` of their shingles or more, in
    order of id, as (item_id, shared, in_doc).

    Items are compared by all of their shingles, so the shares are exact however
    short an item is. Items of up to ``sent`` shingles in all are looked up in the
    pass that makes the sketches, and nothing is shuffled; more are joined, with
    the same result. Items of null id or without a word are held by none; items of
    equal text are held together."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    limit = (1 << 63) // scale
    named = pick(items, item_id, item_text).toDF("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "text"):
                hashes, of = _distinct(part, width)
                n = np.bincount(of, minlength=part.num_rows)[of]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), pa.array(n), pa.array(hashes)], names=["item_id", "n", "h"])

    wanted = cut(named.mapInArrow(spread, "item_id long, n long, h long").distinct(), "items")
    if wanted.limit(sent + 1).count() > sent:
        return _fingerprints_by_join(rows, wanted, spread, width, scale, share)
    table_ = wanted.toArrow()
    h, item, n = (table_.column(c).to_numpy() for c in ("h", "item_id", "n"))
    ids, first, place = np.unique(item, return_index=True, return_inverse=True)
    order = np.argsort(h, kind="stable")
    distinct, at = np.unique(h[order], return_index=True)
    known = rows.sparkSession.sparkContext.broadcast((distinct, np.append(at, len(h)), place[order], ids, n[first] if len(n) else n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, at, place, ids, n = known.value
        for batch in batches:
            for part in V.slices(batch, "text"):
                hashes, of = _distinct(part, width)
                rows_, count = part.num_rows, np.bincount(of, minlength=part.num_rows).astype(np.int64)
                new = hashes < limit
                offsets = np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=rows_))]).astype(np.int32)
                hit = np.flatnonzero(_among(hashes, distinct))
                key = np.searchsorted(distinct, hashes[hit])
                times = at[key + 1] - at[key]
                total = np.cumsum(times)
                which = place[np.arange(total[-1] if len(total) else 0) + np.repeat(at[key] - (total - times), times)]
                pair, shared = np.unique(np.repeat(of[hit], times) * max(len(ids), 1) + which, return_counts=True)
                row, which = pair // max(len(ids), 1), pair % max(len(ids), 1)
                part_of = shared / n[which] if len(which) else np.zeros(0)
                ok = part_of >= share
                held = pa.StructArray.from_arrays([pa.array(ids[which[ok]], pa.int64()), pa.array(shared[ok], pa.int64()), pa.array(part_of[ok], pa.float64())], names=["item_id", "shared", "in_doc"])
                lists = np.concatenate([[0], np.cumsum(np.bincount(row[ok], minlength=rows_))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(count), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[new])), pa.ListArray.from_arrays(pa.array(lists), held)],
                    names=["doc_id", "n_shingles", "sketch", "held"],
                )

    return rows.mapInArrow(run, widened(rows.drop("text"), n_shingles="long", sketch="array<long>", held=HELD))


def _fingerprints_by_join(rows: DataFrame, wanted: DataFrame, spread, width: int, scale: int, share: float) -> DataFrame:
    hashed = rows.where("doc_id is not null").mapInArrow(spread, "item_id long, n long, h long").select(F.col("item_id").alias("d"), "h").distinct()
    met = hashed.join(wanted, "h").groupBy("d", "item_id").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    met = met.select("d", F.struct("item_id", "shared", (F.col("shared") / F.col("n")).alias("in_doc")).alias("x")).where(F.col("x.in_doc") >= share)
    per = met.groupBy("d").agg(F.array_sort(F.collect_list("x")).alias("held"))
    out = sketches(rows, width=width, scale=scale).join(per, F.col("doc_id").cast("bigint") == F.col("d"), "left").drop("d")
    return out.withColumn("held", F.coalesce("held", F.array().cast(HELD)))


def op3_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50 against all others."""
    return searched(table(spark, sf_dir, "documents"))


def op3_source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a_id, b_id, shared, in_b): of the merged sketches of every two sources, which
    share of the one's shingles the other is estimated to hold."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    each = merged(sketches(docs.select(F.col("source").alias("doc_id"), "text")).withColumnRenamed("doc_id", "source"), "source")
    each = cut(each, "sources")
    return containment(each, each, "source").where("a_id <> b_id")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents, and the benchmark passages each of them holds."""
    return fingerprints(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
