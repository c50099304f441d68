"""Phrases in texts: who is mentioned where, in either direction.

Names are phrases, texts are tokens with positions. Both directions are one join
of phrase slots with tokens, and a window over displacements (``sloppy``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..scratch import written
from ..settings import SETTINGS
from ..sources.transform import values
from .fulltext import SearchIndex, sloppy

#: Weight of a match by the kind of name.
TAGS = {"name": 2.0, "other_name": 0.8}
#: So many ids of documents, counted, are sent to all tasks.
FEW_IDS = 100_000


def phrase_table(names: DataFrame, analyzer: str = "folded") -> DataFrame:
    """(entity_id, tag, name, phrase, slot, term, n_slots) of names (entity_id, tag,
    name): a row for each token, by the analysis of the text field."""
    spread = names.distinct().withColumn("ts", X.words(F.col("name"), analyzer)).where(F.size("ts") > 0)
    return spread.select(
        "entity_id", "tag", "name", F.xxhash64("ts").alias("phrase"), F.size("ts").alias("n_slots"), F.posexplode("ts").alias("slot", "term")
    )


def names_of(docs: DataFrame, strict: bool = True) -> DataFrame:
    """(entity_id, tag, name): names of entities that are worth looking for. Aliases
    and former names are ``other_name``."""
    clean = N.clean_names_column if strict else (lambda c: F.array_distinct(c))
    main = docs.select(F.col("_id").alias("entity_id"), F.lit("name").alias("tag"), F.explode(clean(values("name"))).alias("name"))
    rest = F.concat(values("alias"), values("previousName"), values("weakAlias"))
    return main.unionByName(docs.select(F.col("_id").alias("entity_id"), F.lit("other_name").alias("tag"), F.explode(clean(rest)).alias("name")))


def text_tokens(texts: DataFrame, id_col: str = "_id", text_col: str = "content", analyzer: str = "folded") -> DataFrame:
    """(_id, term, pos) of texts; several values follow each other with a gap."""
    column = F.col(text_col)
    if texts.schema[text_col].dataType.typeName() == "array":
        column = F.array_join(column, " " + " ".join(["␞"] * 100) + " ")
    return X.exploded(texts, column, analyzer, F.col(id_col).alias("_id")).select("_id", "term", "pos")


def found(phrases: DataFrame, tokens: DataFrame | SearchIndex, slop: int = SETTINGS.percolate_slop, field: str = "content") -> DataFrame:
    """(phrase, _id, freq): where each distinct phrase is, among tokens or in a field of
    an index. A phrase is looked for only in texts that have the rarest of its terms,
    so that common words never meet all texts; pairs that lack a slot go before the
    window. Candidates are written; of an index only their documents' postings are met,
    and positions are spread out of those that have every slot."""
    slots = phrases.select("phrase", "slot", "term", "n_slots").distinct()
    wanted = slots.select("term").distinct()
    post = None
    if isinstance(tokens, SearchIndex):
        post = tokens.post.where(F.col("field") == field)
        if tokens.terms is None:
            post = written(post.join(wanted, "term", "left_semi").select("term", "_id", "positions"), "places")
            df = post.groupBy("term").agg(F.count("*").alias("df"))
        else:
            known = tokens.terms.where(F.col("field") == field).join(wanted, "term", "left_semi")
            df, post = known.select("term", "df"), post.join(known.select("tb", "term"), ["tb", "term"], "left_semi")
        places = post.select("_id", "term")
    else:
        places = tokens.select("_id", "term").distinct().join(wanted, "term", "left_semi")
        df = places.groupBy("term").agg(F.count("*").alias("df"))
    rarest = slots.join(df, "term", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r"))
    anchors = rarest.where("r.df > 0").select("phrase", F.col("r.term").alias("term"))
    candidates = written(places.join(anchors, "term").select("_id", "phrase"), "candidates")
    if post is None:
        met = candidates.join(slots, "phrase").join(tokens, ["_id", "term"])
        n = F.count_distinct("slot")
    else:
        ids = written(candidates.select("_id").distinct(), "ids")
        near = post.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "_id", "left_semi").select("_id", "term", "positions")
        met, n = candidates.join(slots, "phrase").join(near, ["_id", "term"]), F.count("*")
    whole = met.where("n_slots > 1").groupBy("phrase", "_id", "n_slots").agg(n.alias("n")).where("n = n_slots").select("phrase", "_id")
    single, left = met.where("n_slots = 1"), met.where("n_slots > 1").join(whole, ["phrase", "_id"])
    if post is not None:
        single, left = (df.withColumn("pos", F.explode("positions")) for df in (single, left))
    once = single.groupBy("phrase", "_id").agg(F.count("*").cast("double").alias("freq"))
    return once.unionByName(sloppy(left.select("phrase", "_id", "slot", "pos", "n_slots"), slop, ["phrase", "_id"]))


def percolate(names: DataFrame, texts: DataFrame | SearchIndex, id_col: str = "_id", text_col: str = "content", slop: int = SETTINGS.percolate_slop) -> DataFrame:
    """(_id, entity_id, score, tags, fired) of every text and every entity mentioned in
    it. Each name adds its tag's weight times its words; tags and names that fired
    are listed in order."""
    phrases = phrase_table(names)
    hits = found(phrases, texts if isinstance(texts, SearchIndex) else text_tokens(texts, id_col, text_col), slop, text_col)
    per = phrases.select("entity_id", "tag", "name", "phrase", "n_slots").distinct()
    weight = F.lit(0.0)
    for tag, w in TAGS.items():
        weight = F.when(F.col("tag") == tag, w).otherwise(weight)
    return (
        hits.join(per, "phrase")
        .groupBy("_id", "entity_id")
        .agg(
            F.sum(weight * F.col("n_slots") * F.col("freq") / (F.col("freq") + SETTINGS.bm25_k1)).alias("score"),
            F.array_sort(F.collect_set("tag")).alias("tags"), F.array_sort(F.collect_set("name")).alias("fired"),
        )
    )


def mentions(names: DataFrame, docs: DataFrame | SearchIndex, slop: int = SETTINGS.percolate_slop, names_col: str | None = "names", text_col: str = "content") -> DataFrame:
    """(_id, score, mention_sources): documents that mention any of the entities, by
    their text, or by a name of their own (which weighs double). The score is the
    sum over entities; a name that several share counts for each of them."""
    phrases = phrase_table(names)
    hits = found(phrases, docs if isinstance(docs, SearchIndex) else text_tokens(docs, "_id", text_col), slop, text_col).join(phrases.select("entity_id", "phrase", "n_slots").distinct(), "phrase")
    fired = hits.select("_id", "entity_id", (F.col("n_slots") * F.col("freq") / (F.col("freq") + SETTINGS.bm25_k1)).alias("score"))
    if names_col:
        own = (docs.docs if isinstance(docs, SearchIndex) else docs).select("_id", F.explode(F.array_distinct(names_col)).alias("key"))
        wanted = names.select("entity_id", N.name_normal(F.col("name")).alias("key")).distinct()
        fired = fired.unionByName(own.join(wanted, "key").select("_id", "entity_id", F.lit(2.0).alias("score")))
    per = fired.groupBy("_id", "entity_id").agg(F.sum("score").alias("score"))
    return per.groupBy("_id").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("entity_id")).alias("mention_sources"))


