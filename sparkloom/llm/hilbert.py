"""Shards along a Hilbert curve through several metadata dimensions.

Each dimension is quantised into 2^bits ranks of about equally many rows. The
grid of ranks has a bounded number of cells, whatever the size of the data, so
the curve and the cuts are worked out over the cells, and the rows are shuffled
once, straight to their shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Positional, cut, table

DIMENSIONS, BITS, SHARD_BYTES = ("source", "lang", "n_chars"), 6, 64 << 20
#: Of files that a reader with selective filters likes better.
FINE_BYTES = 1 << 16


def curve_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of ranks (Skilling, "Programming the Hilbert
    curve", 2004)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _rank(df: DataFrame, column: str, bits: int) -> Column:
    """floor(2^bits * rows of smaller value / rows), null being the least value.
    Distinct values are sorted by ranges, each range by a task of its own; the
    running sum is over the ranges first, then inside each. At most 2^bits bounds
    come to the driver."""
    per = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    per = cut(per.repartitionByRange(F.col("v").asc_nulls_first()).withColumn("range", F.spark_partition_id()), "values")
    ranges = per.groupBy("range").agg(F.sum("n").alias("in_range"))  # a row a partition
    upto = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("in_range").over(upto), F.lit(0)).alias("start"), F.sum("in_range").over(W.partitionBy()).alias("total"))
    inside = W.partitionBy("range").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    ranked = per.join(F.broadcast(ranges), "range").select("v", F.floor((F.lit(1 << bits) * before) / F.col("total")).cast("int").alias("q"))
    bounds = sorted(((r.v, r.q) for r in ranked.groupBy("q").agg(F.min("v").alias("v")).collect() if r.v is not None), key=lambda r: r[1])
    if not bounds:
        return F.lit(0)
    least = F.array(*[F.lit(v) for v, _ in bounds])
    passed = F.size(F.filter(least, lambda b: b <= F.col(column)))
    return F.coalesce(F.get(F.array(*[F.lit(q) for _, q in bounds]), passed - 1), F.lit(0))


def _piece(id_col: str) -> Column:
    """A number from 0 to 2^32 - 1 that spreads rows of one cell."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")


def shards(
    docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text",
    bits: int = BITS, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """All rows with all their columns, ``curve_index`` and ``shard``; one
    partition for each shard, in order of the curve, and of id on a cell.

    A shard is a run of cells of about ``shard_bytes`` of text; a cell that is
    larger is split over several by a hash of the id. A null text has 0 bytes, a
    null in a dimension is its least value, rows that repeat stay. Columns named
    curve_index or shard are replaced. An empty table gives no rows."""
    p = Positional(docs)
    named = {d: p.at(d) for d in dimensions}
    ranks = [f"q{i}" for i in range(len(dimensions))]
    df = p.df.withColumns({q: _rank(p.df, c, bits) for q, c in zip(ranks, named.values())})
    size = F.coalesce(F.octet_length(F.col(p.at(text_col)).cast("string")), F.lit(0))
    cells = df.groupBy(*ranks).agg(F.sum(size).alias("bytes")).toPandas()
    cells["h"] = curve_index(cells[ranks].to_numpy(np.int64), bits) if len(cells) else []
    cells = cells.sort_values("h", ignore_index=True)
    cells["start"] = cells.bytes.cumsum() - cells.bytes
    n = int(cells.bytes.sum()) // shard_bytes + 1
    where = docs.sparkSession.createDataFrame(
        cells[[*ranks, "h", "start", "bytes"]].astype("int64"), ", ".join(f"{c} bigint" for c in [*ranks, "h", "start", "bytes"])
    )
    whole = F.col("bytes") <= shard_bytes
    inside = F.when(whole, 0).otherwise(F.floor(F.col("bytes").cast("double") * _piece(p.at(id_col)) / float(1 << 32)))
    placed = (
        df.join(F.broadcast(where), ranks)  # at most 2^(bits * dimensions) rows
        .withColumn("shard__", F.floor((F.col("start") + inside) / shard_bytes).cast("int"))
        .repartitionById(n, F.col("shard__"))
        .sortWithinPartitions("shard__", "h", p.at(id_col))
    )
    kept = [(i, c) for i, c in zip(p.inner, p.names) if c.lower() not in ("curve_index", "shard")]
    return placed.select(*[F.col(i).alias(c) for i, c in kept], F.col("h").alias("curve_index"), F.col("shard__").alias("shard"))


def manifest(sharded: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Of each shard: rows, and least and greatest value of each dimension."""
    ends = [f(d).alias(f"{a}_{d}") for d in dimensions for f, a in ((F.min, "min"), (F.max, "max"))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *ends)


def pruned(ends: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """The shards of a manifest that may hold rows within all bounds (least,
    greatest; None is open)."""
    for d, (lo, hi) in bounds.items():
        if lo is not None:
            ends = ends.where(F.col(f"max_{d}") >= F.lit(lo))
        if hi is not None:
            ends = ends.where(F.col(f"min_{d}") <= F.lit(hi))
    return ends


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def op9_hilbert_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What shards of ``FINE_BYTES`` hold: rows, and the ends of each dimension."""
    return manifest(shards(table(spark, sf_dir, "documents"), shard_bytes=FINE_BYTES))


def manifest_sql() -> str:
    ends = ", ".join(f"min({d}) AS min_{d}, max({d}) AS max_{d}" for d in DIMENSIONS)
    return f"SELECT shard, count(*) AS n_rows, {ends} FROM ({oracle_sql(shard_bytes=FINE_BYTES)}) GROUP BY 1"


def oracle_sql(bits: int = BITS, shard_bytes: int = SHARD_BYTES) -> str:
    """The curve, step by step, each step a subquery over the cells."""
    rank = lambda d: (
        f"SELECT v, floor({1 << bits} * coalesce(sum(n) OVER (ORDER BY v NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER ())::BIGINT AS q "
        f"FROM (SELECT {d} AS v, count(*) AS n FROM documents GROUP BY 1)"
    )
    step = "SELECT q0, q1, q2, bytes, q0 AS x0, q1 AS x1, q2 AS x2 FROM cells"
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(3):
            high, swap = f"(x{i} & {q}) <> 0", f"(xor(x0, x{i}) & {q - 1})"
            new = {0: f"CASE WHEN {high} THEN xor(x0, {q - 1}) ELSE xor(x0, {swap}) END"}
            if i:
                new[i] = f"CASE WHEN {high} THEN x{i} ELSE xor(x{i}, {swap}) END"
            step = f"SELECT q0, q1, q2, bytes, {', '.join(f'{new.get(k, f'x{k}')} AS x{k}' for k in range(3))} FROM ({step})"
        q >>= 1
    step = f"SELECT q0, q1, q2, bytes, x0, xor(x0, x1) AS x1, xor(xor(x0, x1), x2) AS x2 FROM ({step})"
    t = "0"
    for b in range(bits - 1, 0, -1):
        t = f"xor({t}, CASE WHEN (x2 & {1 << b}) <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    step = f"SELECT q0, q1, q2, bytes, {', '.join(f'xor(x{k}, {t}) AS x{k}' for k in range(3))} FROM ({step})"
    digits = [f"(((x{i} >> {b}) & 1) << {3 * b + 2 - i})" for b in range(bits) for i in range(3)]
    return f"""
    WITH r0 AS ({rank("source")}), r1 AS ({rank("lang")}), r2 AS ({rank("n_chars")}),
    d AS (
      SELECT documents.*, r0.q AS q0, r1.q AS q1, r2.q AS q2 FROM documents
      JOIN r0 ON source IS NOT DISTINCT FROM r0.v JOIN r1 ON lang IS NOT DISTINCT FROM r1.v JOIN r2 ON n_chars IS NOT DISTINCT FROM r2.v),
    cells AS (SELECT q0, q1, q2, sum(coalesce(strlen(text), 0))::BIGINT AS bytes FROM d GROUP BY ALL),
    curve AS (SELECT q0, q1, q2, bytes, {" + ".join(digits)} AS h FROM ({step})),
    cut AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM curve)
    SELECT doc_id, text, lang, source, n_chars, h AS curve_index,
      floor((start + CASE WHEN bytes <= {shard_bytes} THEN 0 ELSE floor(bytes::DOUBLE * ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296) END) / {shard_bytes})::INTEGER AS shard
    FROM d JOIN cut USING (q0, q1, q2)
    """
