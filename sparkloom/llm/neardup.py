"""Near duplicates by an inverted join over MinHash signature coordinates.

Each document has K coordinates: the least value of K hash functions over its
word shingles. It is posted under every (coordinate, value) pair. Two documents
match when they collide in ``min_matches`` coordinates or more.

Candidates come from the posting lists without a cap:

* documents of equal signature are one node from the start;
* a pair held by one node only can't collide and is dropped; a node with fewer
  than ``min_matches`` pairs left can't match at all (exact);
* prefix merging: with c pairs left, in order of list length, two nodes that
  match share one among the first c - min_matches + 1 of each (exact);
* skip merging: members of a list are compared with its least node. What that
  connects isn't compared again, so a list of n copies costs n comparisons;
* a list of few members beside its largest component is compared pair by pair but
  for that. In others more nodes are tried, and what is left is divided by the
  next pair its members share, with the same prefix rule over what is left (two
  that match share ``min_matches`` pairs, so also one of the next few), until the
  parts are connected or few. So no long list is compared all with all, and none
  is capped (exact).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import vectext as V
from .common import Positional, cut, pick, row_keys, table, widened
from .graph import components

WIDTH, COORDINATES, MIN_MATCHES = 3, 64, 28
#: So many members of a list, beside its largest component, are compared with all of it.
SMALL = 64
#: With so many nodes a list is compared if its least one doesn't connect most of it.
PROBES = 4


def multipliers(k: int) -> list[tuple[int, int]]:
    """The hash functions x -> (a x + b) mod 2^64 >> 32, a odd."""
    x, out = 0x2545F4914F6CDD1D, []
    for _ in range(k):
        pair = []
        for _ in range(2):
            x = (x + V.BASE) & V.MASK
            z = (x ^ (x >> 30)) * V.MIX1 & V.MASK
            z = (z ^ (z >> 27)) * V.MIX2 & V.MASK
            pair.append(z ^ (z >> 31))
        out.append((pair[0] | 1, pair[1]))
    return out


def signature_matrix(texts: pa.Array, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of k coordinates for each text that has words, and which texts do."""
    hashes, starts = V.shingles_of(texts, width)
    some = np.diff(starts) > 0
    out = np.empty((int(some.sum()), k), np.uint32)
    if len(out):
        cuts = starts[:-1][some]
        for i, (a, b) in enumerate(multipliers(k)):
            out[:, i] = np.minimum.reduceat((hashes * V.U64(a) + V.U64(b)) >> V.U64(32), cuts)
    return out, some


def signatures(df: DataFrame, width: int = WIDTH, k: int = COORDINATES) -> DataFrame:
    """Adds ``sig`` (k unsigned 32-bit numbers, little-endian) to a table with a
    ``text`` and takes the text away. Texts without a word get null."""
    rest = [f for f in df.schema.fields if f.name != "text"]
    schema = widened(df.drop("text"), sig="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "text"):
                sig, some = signature_matrix(part.column("text"), width, k)
                offsets = np.zeros(len(some) + 1, np.int32)
                np.cumsum(some * (4 * k), out=offsets[1:])
                mask = np.packbits(some, bitorder="little")
                made = pa.Array.from_buffers(
                    pa.binary(), len(some), [pa.py_buffer(mask.tobytes()), pa.py_buffer(offsets), pa.py_buffer(sig.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in rest), made], names=[*(f.name for f in rest), "sig"]
                )

    return df.mapInArrow(run, schema)


def _matrix(sig: pa.Array, k: int) -> np.ndarray:
    raw = sig.buffers()[2]
    at = np.frombuffer(sig.buffers()[1], np.int32)[sig.offset]
    return np.frombuffer(raw, np.uint8)[at : at + len(sig) * 4 * k].view(np.uint32).reshape(-1, k)


def _postings(nodes: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = np.arange(k, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            key = (_matrix(batch.column("sig"), k) | tag).ravel().view(np.int64)
            node = np.repeat(batch.column("node").to_numpy(), k)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(key)], names=["node", "key"])

    return nodes.mapInArrow(run, "node long, key long")


def _matching(pairs: DataFrame, nodes: DataFrame, k: int, least: int) -> DataFrame:
    """The pairs (a, b) that collide often enough, with ``matches``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (_matrix(batch.column("sa"), k) == _matrix(batch.column("sb"), k)).sum(1)
            ok = n >= least
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("a").to_numpy()[ok]), pa.array(batch.column("b").to_numpy()[ok]), pa.array(n[ok].astype(np.int32))],
                names=["a", "b", "matches"],
            )

    return (
        pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        .join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(run, "a long, b long, matches int")
    )


def _ordered(nodes: DataFrame, k: int, least: int) -> DataFrame:
    """(node, key, rank, c): of each node its c pairs that other nodes have too, rare
    ones first; nodes of fewer than ``least`` can't match. Lengths of lists are partial
    sums, joined, so that a hot list is never in one task."""
    posted = _postings(nodes, k)
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    per_node = W.partitionBy("node")  # at most k rows
    return (
        posted.join(shared, "key")
        .withColumn("c", F.count("*").over(per_node))
        .where(F.col("c") >= least)
        .withColumn("rank", F.row_number().over(per_node.orderBy("n", "key")))
        .select("node", "key", "rank", "c")
    )


def _rooted(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return lists.withColumn("root", F.col("node"))
    return lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _starred(lists: DataFrame, roots: DataFrame | None, nodes: DataFrame, k: int, least: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """Compares each list's members with its least one in each of the orders. The
    lists of more than one component, and the components (node, root) there are now."""
    rooted = _rooted(lists, roots)
    hubs = F.array_distinct(F.array(*[F.min_by(F.struct("node", "root"), o) for o in order]))
    per = rooted.groupBy("list").agg(F.min("root").alias("a"), F.max("root").alias("b"), hubs.alias("hubs")).where("a <> b").drop("a", "b")
    held = cut(rooted.join(per, "list"), "lists")
    stars = held.select("node", "root", F.explode("hubs").alias("h")).where("h.root <> root")
    near = _matching(stars.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct(), nodes, k, least)
    return held.select("list", "node", "rank", "c"), _joined(near, roots)


def _joined(near: DataFrame, roots: DataFrame | None) -> DataFrame:
    edges = near.select("a", "b")
    return components(edges if roots is None else edges.union(roots.select("node", "root")))


def _compared(lists: DataFrame, roots: DataFrame, nodes: DataFrame, k: int, least: int, small: int) -> tuple[DataFrame, DataFrame]:
    """Compares all that isn't connected in the lists of at most ``small`` members
    beside their largest component. The other open lists, and the components."""
    rooted = _rooted(lists, roots)
    sizes = rooted.groupBy("list", "root").agg(F.count("*").alias("m"))
    per = sizes.groupBy("list").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("n")).where("top.m < n")
    left = cut(rooted.join(per.select("list", F.col("top.root").alias("top"), (F.col("n") - F.col("top.m")).alias("rest")), "list"), "open")
    few = left.where(F.col("rest") <= small)
    if not few.isEmpty():
        pairs = few.where("root <> top").select("list", F.col("node").alias("u"), F.col("root").alias("r")).join(few.select("list", "node", "root"), "list")
        pairs = pairs.where("r <> root").select(F.least("u", "node").alias("a"), F.greatest("u", "node").alias("b")).distinct()
        roots = _joined(_matching(pairs, nodes, k, least), roots)
    return left.where(F.col("rest") > small).select("list", "node", "rank", "c"), roots


def matched_components(nodes: DataFrame, k: int = COORDINATES, least: int = MIN_MATCHES, small: int = SMALL) -> DataFrame:
    """(node, root) of the nodes (node, sig), of distinct signature, that match
    another one: the connected components of all matching pairs."""
    ordered = cut(_ordered(nodes, k, least), "ordered")
    lists, roots = ordered.where(F.col("rank") <= F.col("c") - least + 1).select(F.col("key").alias("list"), "node", "rank", "c"), None
    for depth in range(1, k + 1):
        lists, roots = _starred(lists, roots, nodes, k, least, F.col("node"))
        lists, roots = _compared(lists, roots, nodes, k, least, small)
        if lists.isEmpty():
            return roots
        lists, roots = _starred(lists, roots, nodes, k, least, *[F.xxhash64("list", "node", F.lit(i)) for i in range(PROBES)])
        lists, roots = _compared(lists, roots, nodes, k, least, small)
        if lists.isEmpty():
            return roots
        #: Who matches shares least - depth more pairs beyond the last one, and so one of the first of them.
        further = lists.withColumnRenamed("rank", "upto").join(ordered.drop("c"), "node")
        lists = further.where((F.col("rank") > F.col("upto")) & (F.col("rank") <= F.col("c") - least + depth + 1)).select(
            F.xxhash64("list", "key").alias("list"), "node", "rank", "c"
        )
    return roots


def grouped(rows: DataFrame, width: int = WIDTH, k: int = COORDINATES, least: int = MIN_MATCHES) -> DataFrame:
    """(columns of rows without text, root): rows of equal root are near duplicates.
    Rows without a word aren't in the result."""
    signed = cut(
        signatures(rows, width, k).where("sig is not null").withColumn("node", F.xxhash64("sig")), "signed"
    )
    nodes = cut(signed.groupBy("node").agg(F.first("sig").alias("sig")), "nodes")
    label = matched_components(nodes, k, least)
    return (
        signed.drop("sig")
        .join(label, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .drop("node")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = COORDINATES, least: int = MIN_MATCHES
) -> DataFrame:
    """(doc_id, keep_id): each document of a group but the one of the least id,
    with that id.

    Texts that are null, empty or without a letter or digit match nothing. Texts
    of fewer than ``width`` words match by all their words. Rows of a null id come
    as null, and are never kept if another of their group has an id. Repeated rows
    of an id count once. Only the two columns are read; an empty table gives an
    empty result."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    all_rows = grouped(rows, width, k, least)
    groups = all_rows.groupBy("root").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    return (
        all_rows.join(groups, "root")
        .where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "keep_id")
        .distinct()
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = COORDINATES, least: int = MIN_MATCHES
) -> DataFrame:
    """The documents, with all their columns, but one row only of each group (the
    least id; of rows that are equal in all columns, one). Texts without a word
    are all kept. The texts are shuffled once."""
    p = Positional(docs)
    r1, r2 = row_keys(p.inner)
    keyed = p.df.withColumns({"r1": r1, "r2": r2})
    rows = keyed.select("r1", "r2", F.col(p.at(id_col)).alias("doc_id"), F.col(p.at(text_col)).cast("string").alias("text"))
    all_rows = cut(grouped(rows, width, k, least), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")).alias("first")
    groups = all_rows.groupBy("root").agg(first, F.count("*").alias("n")).where("n > 1")
    fate = (
        all_rows.join(groups, "root")
        .select("r1", "r2", ((F.col("first.r1") == F.col("r1")) & (F.col("first.r2") == F.col("r2"))).alias("stays"))
        .distinct()
    )
    once = F.row_number().over(W.partitionBy("r1", "r2").orderBy("r1"))
    left = (
        keyed.join(fate, ["r1", "r2"], "left")
        .withColumn("copy", once)
        .where("stays is null or (stays and copy = 1)")
    )
    return p.restore(left)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
