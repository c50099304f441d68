"""From raw documents to token ids: the corpus pipeline, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import kneser, langid, mixing, neardup, pieces
from sparkloom.llm.common import cut, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that is known stay, with it as their ``lang``."""
    return langid.keep(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity isn't above their language's limit stay."""
    return kneser.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mixing schedule: those of a source beyond its
    target don't come, those of a source short of it come again."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its ``ids``."""
    return pieces.tokenized(docs)


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
