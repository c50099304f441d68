"""Mixing sources to target weights with a low-discrepancy schedule.

Slot i of the schedule has the point frac(i * golden ratio), as an integer of 32
bits; cumulative weights map it to a source. The k-th slot of a source takes its
block k modulo its number of blocks. Blocks are runs of equally many tokens of
the source's documents in shuffled order. After n slots each source is within a
few blocks of n times its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Positional, cut, pick, prefix_sums, row_keys, table

BLOCK_TOKENS, EXPONENT, SEED, SLOTS_PER_FILE = 8192, 0.7, 17, 1024
GOLDEN, ONE, BINS = 2654435769, 1 << 32, 4096


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("bigint")


def _narrow(df: DataFrame, keys: list[Column], id_col: str, source: str, text: str) -> DataFrame:
    """What the schedule needs of each document that has tokens."""
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return df.select(
        *keys, F.col(id_col).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        _tokens(F.col(text)).alias("tokens"), order.alias("o"),
    ).where("tokens > 0")


def _sources(rows: DataFrame, weights: dict[str, float] | None, exponent: float, block: int) -> DataFrame:
    """Of each source its number of blocks and its share [lo, hi) of the points."""
    per = rows.groupBy("source").agg(F.sum("tokens").alias("t"))
    w = F.pow(F.col("t").cast("double"), F.lit(exponent)) if weights is None else _given(weights)
    per = per.withColumn("w", w).where("w > 0")
    upto = W.orderBy("source").rowsBetween(W.unboundedPreceding, 0)  # one row a source
    every = W.partitionBy()
    return per.select(
        "source",
        F.ceil(F.col("t") / block).cast("bigint").alias("blocks"),
        F.round((F.sum("w").over(upto) - F.col("w")) / F.sum("w").over(every) * ONE).cast("bigint").alias("lo"),
        F.round(F.sum("w").over(upto) / F.sum("w").over(every) * ONE).cast("bigint").alias("hi"),
    )


def _given(weights: dict[str, float]) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(known, F.col("source")), F.lit(0.0))


def _schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """(slot, source, epoch, block) of every slot."""
    spark = sources.sparkSession
    point = (F.col("slot") % (1 << 31)) * GOLDEN % ONE
    slots = spark.range(n_slots).toDF("slot").withColumn("u", point).withColumn("bin", F.floor(F.col("u") / (ONE // BINS)))
    shares = sources.where("hi > lo").withColumn(
        "bin", F.explode(F.sequence(F.floor(F.col("lo") / (ONE // BINS)), F.floor((F.col("hi") - 1) / (ONE // BINS))))
    )
    drawn = (
        slots.join(shares, "bin")
        .where("lo <= u and u < hi")
        .select("slot", "source", "blocks", F.shiftright("slot", 16).alias("run"), F.lit(1).alias("one"))
    )
    ranked = prefix_sums(drawn, ["source"], "run", [F.col("slot")], "one", "k")
    return ranked.select(
        "slot", "source", F.floor(F.col("k") / F.col("blocks")).alias("epoch"), (F.col("k") % F.col("blocks")).alias("block")
    )


def _plan(rows: DataFrame, keys: list[str], weights: dict[str, float] | None, exponent: float, block: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows with the offset ``at`` of their first token in their source; the
    schedule; its number of slots (one for each block there is)."""
    sources = cut(_sources(rows, weights, exponent, block), "sources")
    n = sources.agg(F.sum("blocks")).first()[0] or 0
    placed = prefix_sums(
        rows.withColumn("run", F.substring("o", 1, 3)), ["source"], "run", [F.col(c) for c in ("o", "doc_id", *keys)], "tokens", "at"
    )
    return placed, _schedule(sources, n), n


def mixed(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None,
    exponent: float = EXPONENT, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(slot, epoch, source, block, doc_id, tok_from, tok_to): the spans of
    documents that fill each slot of the schedule.

    Tokens are runs of non-blank characters. ``weights`` are each source's target
    (any scale; a source that isn't named gets none); without them a source's
    weight is its tokens to the power of ``exponent``. There are as many slots as
    blocks; a source of more slots than blocks begins again (``epoch``). The last
    block of a source may be short. Documents without tokens (null, empty, blank)
    fill nothing; a null source is the source of empty name; a document that
    repeats is used as often as it is there; equal ids are ordered by content.
    Other columns are left out, and an empty table gives an empty schedule."""
    p = pick(docs, id_col, source_col, text_col)
    k1, k2 = row_keys(p.columns)
    rows = cut(_narrow(p, [k1.alias("k1"), k2.alias("k2")], id_col, source_col, text_col), "mix")
    placed, schedule, _ = _plan(rows, ["k1", "k2"], weights, exponent, block_tokens)
    first, end = F.col("block") * block_tokens - F.col("at"), F.col("at") + F.col("tokens")
    spans = placed.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("at") / block_tokens), F.floor((end - 1) / block_tokens)))
    ).select(
        "source", "block", "doc_id",
        F.greatest(first, F.lit(0)).alias("tok_from"), F.least(first + block_tokens, F.col("tokens")).alias("tok_to"),
    )
    return schedule.join(spans, ["source", "block"]).select("slot", "epoch", "source", "block", "doc_id", "tok_from", "tok_to")


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None,
    exponent: float = EXPONENT, block_tokens: int = BLOCK_TOKENS, slots_per_file: int = SLOTS_PER_FILE,
) -> DataFrame:
    """Whole documents, with all their columns, in the order of the schedule of
    ``mixed``: a document is where its first token is, and comes once for each
    slot of that block. One partition for each ``slots_per_file`` slots. The
    schedule is worked out without the texts, which are then shuffled twice: to
    their row's slots, and to their place."""
    p = Positional(docs)
    k1, k2 = row_keys(p.inner)
    keyed = p.df.withColumns({"k1": k1, "k2": k2})
    narrow = _narrow(keyed, ["k1", "k2"], p.at(id_col), p.at(source_col), p.at(text_col))
    one = narrow.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "o")], F.sum("tokens").alias("tokens"))
    placed, schedule, n = _plan(cut(one, "mix"), ["k1", "k2"], weights, exponent, block_tokens)
    slots = placed.withColumn("block", F.floor(F.col("at") / block_tokens)).join(schedule, ["source", "block"]).select("k1", "k2", "slot", "at")
    files = n // slots_per_file + 1
    return p.restore(
        keyed.join(slots, ["k1", "k2"])
        .repartitionById(files, F.floor(F.col("slot") / slots_per_file).cast("int"))
        .sortWithinPartitions("slot", "at")
    )


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def oracle_sql(block: int = BLOCK_TOKENS, exponent: float = EXPONENT) -> str:
    return f"""
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS tokens,
             md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS o
      FROM documents WHERE len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) > 0),
    off AS (
      SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d),
    spans AS (
      SELECT source, doc_id, tokens, start, unnest(generate_series(start // {block}, (start + tokens - 1) // {block})) AS block FROM off),
    s AS (SELECT source, sum(tokens) AS t, power(sum(tokens)::DOUBLE, {exponent}) AS w FROM d GROUP BY 1),
    share AS (
      SELECT source, ceil(t / {block})::BIGINT AS blocks,
        round((sum(w) OVER (ORDER BY source) - w) / sum(w) OVER () * {ONE})::BIGINT AS lo,
        round(sum(w) OVER (ORDER BY source) / sum(w) OVER () * {ONE})::BIGINT AS hi
      FROM s),
    drawn AS (
      SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k
      FROM (SELECT unnest(generate_series(0, (SELECT sum(blocks)::BIGINT - 1 FROM share))) AS slot)
      JOIN share ON (slot % {1 << 31}) * {GOLDEN} % {ONE} >= lo AND (slot % {1 << 31}) * {GOLDEN} % {ONE} < hi)
    SELECT slot, k // blocks AS epoch, source, block, doc_id,
      greatest(block * {block} - start, 0) AS tok_from, least((block + 1) * {block} - start, tokens) AS tok_to
    FROM drawn JOIN spans USING (source) WHERE k % blocks = block
    """
