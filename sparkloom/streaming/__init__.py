"""Structured Streaming: documents as they arrive, and whom they mention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import text as X
from ..operators.phrases import phrase_table
from ..scratch import written
from ..sources import transform
from ..sources.store import EntityStore

#: Words of a text that are looked at together, at least; words that are looked up in a set that comes with the plan.
BLOCK, FEW_TERMS = 256, 10_000


def ingest(entities: DataFrame, store: EntityStore, dataset: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upsert each micro-batch of entities. A batch that is repeated after a failure
    gives the same table, as documents replace those of their id."""

    def put(batch: DataFrame, _: int) -> None:
        store.index(dataset, batch)

    writer = entities.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def percolate_stream(texts: DataFrame, names: DataFrame, slop: int = 2) -> DataFrame:
    """(_id, entity_id, name) of every arriving text (_id, content) and every name it
    mentions: a stateless stream-static join. Each phrase is looked up by its longest
    word, and the rest of it is tested against the words nearby, so no aggregation
    over the stream is needed. A word takes with it only its block of the text, which
    is as long as phrases need; words that aren't looked up go before anything is
    joined, while there are few to look up. Repeats come once for each place."""
    flat = phrase_table(names).groupBy("phrase", "entity_id", "name").agg(
        F.array_sort(F.collect_list(F.struct("slot", "term"))).alias("slots"),
        F.max(F.struct(F.length("term").alias("n"), "term", "slot")).alias("anchor"),
    )
    static = written(flat.select("entity_id", "name", "slots", F.col("anchor.term").alias("term"), F.col("anchor.slot").alias("own")), "phrases")
    reach = (static.agg(F.max(F.size("slots")).alias("n")).first().n or 0) + slop
    block = max(BLOCK, 4 * reach)
    looked_up = [r.term for r in static.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    few = len(looked_up) <= FEW_TERMS
    of_text = texts.select("_id", X.tokens(F.col("content")).alias("ts"))
    starts = F.sequence(F.lit(0), F.coalesce(F.get("ts", F.size("ts") - 1)["pos"], F.lit(0)), F.lit(block))
    blocks = of_text.select("_id", "ts", F.explode(starts).alias("from"))
    toks = blocks.select("_id", "from", F.filter("ts", lambda t: t["pos"].between(F.col("from") - reach, F.col("from") + block - 1 + reach)).alias("ts"))
    wanted = F.filter("ts", lambda t: t["pos"].between(F.col("from"), F.col("from") + block - 1) & (t["term"].isin(looked_up) if few else F.lit(True)))
    starts = toks.select("_id", "ts", F.explode(wanted).alias("t")).select("_id", "ts", F.col("t.term").alias("term"), F.col("t.pos").alias("at"))
    base = F.col("at") - F.col("own")  # the displacement of the word looked up
    near = F.filter("ts", lambda t: t["pos"].between(base - slop, base + F.size("slots") + slop))
    met = starts.join(F.broadcast(static) if few else static, "term").select("_id", "entity_id", "name", "slots", base.alias("base"), near.alias("near"))

    def fits(low):
        """Whether every slot has a word whose displacement is in [low, low + slop]."""
        return F.forall(
            "slots", lambda s: F.exists("near", lambda t: (t["term"] == s["term"]) & (t["pos"] - s["slot"]).between(F.col("base") + low, F.col("base") + low + slop))
        )

    hit = fits(0)
    for low in range(-slop, 0):
        hit = hit | fits(low)
    return met.where(hit).select("_id", "entity_id", "name")


def event_counts(events: DataFrame, at: str = "ts", by: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of time, with a watermark for late ones."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def entity_stream(spark, folder: str, max_files: int = 100) -> DataFrame:
    """Entities of JSON lines files as they arrive in a folder."""
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).schema(T.StructType(transform.ENTITY.fields)).json(folder)
    return raw.where("id is not null")
