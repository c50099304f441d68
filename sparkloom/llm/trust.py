"""Which documents are trusted: by their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Trusted ids are sent to all executors up to this number; beyond, they are joined by a shuffle.
SENT_IDS = 4_000_000


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of which every label row says quality 1 and toxic 0, once each."""
    good = (F.coalesce(F.col("quality") == 1, F.lit(False))) & (F.coalesce(F.col("toxic") == 0, F.lit(False)))
    rows = pick(labels, "doc_id", "quality", "toxic").where("doc_id is not null")
    return rows.groupBy("doc_id").agg(F.bool_and(good).alias("ok")).where("ok").select("doc_id")


def with_trust(docs: DataFrame, labels: DataFrame, *more: str, sent: int = SENT_IDS) -> DataFrame:
    """(doc_id, lang, text, more..., trusted). A document of a null id, or without a
    label, isn't trusted."""
    return flag(pick(docs, "doc_id", "lang", "text", *more), labels, "doc_id", sent)


def flag(df: DataFrame, labels: DataFrame, id_col: str, sent: int = SENT_IDS) -> DataFrame:
    """``df`` with ``trusted``; its other columns must not clash with that."""
    ids = trusted_ids(labels).select(F.col("doc_id").alias("trusted_id"))
    if labels.limit(sent + 1).count() <= sent:
        ids = F.broadcast(ids)
    joined = df.join(ids, df[id_col] == ids["trusted_id"], "left")
    return joined.withColumn("trusted", F.col("trusted_id").isNotNull()).drop("trusted_id")


