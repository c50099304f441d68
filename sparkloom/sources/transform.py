"""From entities (id, schema, properties, context) to documents: one select of derived columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..settings import SETTINGS
from ..functions import names as N

VALUES = "map<string,array<string>>"
_LIST = T.ArrayType(T.StringType())
#: Entities as they come in JSON lines.
ENTITY = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("schema", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), _LIST))]
    + [T.StructField(c, _LIST) for c in ("datasets", "origin", "tags", "referents", "role_id", "profile_id", "mutable", "created_at", "updated_at", "first_seen", "last_seen", "last_change")]
)
FORMATS = ("yyyy", "yyyy-MM", "yyyy-MM-dd", "yyyy-MM-dd'T'HH", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
TRANSLATION = "__translation__"
#: Searchable, but not part of what a hit returns.
HIDDEN_COLUMNS = ("content", "text", "translation", "name", "name_keys", "name_parts", "name_phonetic", "name_symbols", *sorted(set(model.GROUPS.values())))


def parse_date(text: Column) -> Column:
    """A timestamp from a date of any precision; null if it is none."""
    whole = F.regexp_replace(text, r"(\.\d+)?(Z|\+00:00)$", "")
    return F.coalesce(*[F.try_to_timestamp(whole, F.lit(f)) for f in FORMATS])


def parse_number(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def _empty() -> Column:
    return F.array().cast("array<string>")


def values(name: str, properties: str = "properties") -> Column:
    return F.coalesce(F.try_element_at(F.col(properties), F.lit(name)), _empty())


def _together(columns: list[Column]) -> Column:
    return F.concat(*columns) if columns else _empty()


def schema_column(of, kind: str = "string") -> Column:
    """A value for each class, as a column: a literal map looked up by ``schema``."""
    entries = [x for s in model.SCHEMATA.values() for x in (F.lit(s.name), of(s))]
    return F.try_element_at(F.create_map(*entries), F.col("schema")).cast(kind)


def _listed(items) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else _empty()


def geo_points(properties: str = "properties") -> Column:
    """All pairs of a longitude and a latitude that are numbers in range."""
    lon = F.filter(F.transform(values("longitude", properties), parse_number), lambda v: v.between(-180, 180))
    lat = F.filter(F.transform(values("latitude", properties), parse_number), lambda v: v.between(-90, 90))
    return F.flatten(F.transform(lon, lambda x: F.transform(lat, lambda y: F.struct(x.alias("lon"), y.alias("lat")))))


def numeric(types: dict[str, str]) -> Column:
    """Numbers, and dates as seconds since 1970, by property and by group of dates."""

    def read(kind: str, v: Column) -> Column:
        parsed = F.transform(v, parse_number) if kind == "number" else F.transform(v, lambda x: parse_date(x).cast("double"))
        return F.filter(parsed, lambda x: x.isNotNull())

    each = {n: read(k, values(n)) for n, k in sorted(types.items()) if k in model.NUMERIC_TYPES}
    dates = F.concat(*[c for n, c in each.items() if types[n] == "date"])
    entries = [x for n, c in [*each.items(), ("dates", dates)] for x in (F.lit(n), c)]
    return F.map_filter(F.create_map(*entries), lambda k, v: F.size(v) > 0)


def is_entity() -> Column:
    """Whether a row has an id and a concrete class."""
    known = [s.name for s in model.SCHEMATA.values() if not s.abstract]
    return F.col("id").isNotNull() & F.col("schema").isin(known)


def documents(entities: DataFrame, dataset: str | None = None, collection_id: int | None = None, symbols: dict[str, str] | None = None) -> DataFrame:
    """One document for each entity of a concrete class; others are left out.

    ``entities`` has the columns of ``ENTITY``, any of the context may be missing.
    ``symbols`` maps a name's token to a symbol (such as a common first name in all
    scripts to one number). Nulls are as if the value weren't there."""
    for f in ENTITY.fields:
        if f.name not in entities.columns:
            entities = entities.withColumn(f.name, F.lit(None).cast(f.dataType))
    df = entities.where(is_entity())
    if SETTINGS.id_namespace and dataset:
        df = df.withColumn("id", signed_id("id", dataset))
    df = df.withColumn("properties", F.coalesce("properties", F.create_map().cast(VALUES)))
    types = model.property_types()
    running = [n for n, k in types.items() if k in model.TEXT_TYPES and n != "translatedText"]
    index_text = values("indexText")
    is_pages = F.col("schema") == "Pages"
    translated = F.transform(F.filter(index_text, lambda x: x.startswith(TRANSLATION)), lambda x: F.trim(F.substring(x, len(TRANSLATION) + 1, 1 << 30)))
    plain = F.when(is_pages, F.filter(index_text, lambda x: ~x.startswith(TRANSLATION))).otherwise(index_text)
    caption = schema_column(lambda s: _listed(s.captions), "array<string>")
    caption_values = F.flatten(F.transform(caption, lambda c: F.coalesce(F.try_element_at(F.col("properties"), c), _empty())))
    raw_names = F.array_distinct(_together([values(n) for n, k in types.items() if k == "name"]))
    schema = F.col("schema")
    df = df.withColumn("tokens__", N.token_lists(schema, raw_names))
    tokens = F.col("tokens__")
    groups = {
        g: F.array_distinct(_together([values(n) for n, k in types.items() if model.GROUPS.get(k) == g])) for g in sorted(set(model.GROUPS.values())) if g not in ("names", "dates")
    }
    dates = F.array_distinct(F.filter(F.transform(_together([values(n) for n, k in types.items() if k == "date"]), parse_date), lambda d: d.isNotNull()))
    parts = N.name_parts(schema, raw_names, tokens)
    marks = F.create_map(*[F.lit(x) for kv in symbols.items() for x in kv]) if symbols else None
    symbol = F.array_distinct(F.filter(F.transform(parts, lambda p: F.try_element_at(marks, p)), lambda s: s.isNotNull())) if symbols else _empty()
    other = [values(n) for n, k in types.items() if k not in model.TEXT_TYPES and n != "translatedText"]
    first = lambda c: F.get(F.filter(F.coalesce(F.col(c), _empty()), lambda v: v.isNotNull()), F.lit(0))
    stamp = lambda c: F.filter(F.transform(F.coalesce(F.col(c), _empty()), parse_date), lambda v: v.isNotNull())
    flags = F.transform(F.coalesce(F.col("mutable"), _empty()), lambda v: F.coalesce(v.try_cast("boolean"), F.lit(False)))
    n_values = F.aggregate(F.map_values(F.map_filter("properties", lambda k, v: k != "indexText")), F.lit(0), lambda a, v: a + F.size(F.coalesce(v, _empty())))
    owner = F.lit(model.valid_dataset(dataset)) if dataset else F.coalesce(first("datasets"), F.lit("default"))
    created, updated = F.array_min(stamp("created_at")), F.array_max(stamp("updated_at"))
    return df.select(
        F.col("id").alias("_id"), F.trim(owner).alias("dataset"), "schema",
        schema_column(lambda s: _listed(s.ancestors), "array<string>").alias("schemata"),
        F.coalesce(F.get(caption_values, F.lit(0)), F.get(raw_names, F.lit(0)), schema).alias("caption"),
        F.array_distinct(caption_values).alias("name"),
        F.array_distinct(F.filter(F.transform(raw_names, N.name_normal), lambda n: n != "")).alias("names"),
        N.name_keys(tokens).alias("name_keys"), parts.alias("name_parts"),
        N.name_phonetic(schema, tokens).alias("name_phonetic"), symbol.alias("name_symbols"),
        geo_points().alias("geo_point"), F.coalesce("referents", _empty()).alias("referents"),
        F.concat(_together([values(n) for n in running]), plain).alias("content"),
        F.concat(_together(other), parts).alias("text"),
        F.concat(values("translatedText"), F.when(is_pages, translated).otherwise(_empty())).alias("translation"),
        F.coalesce("tags", _empty()).alias("tags"), F.coalesce("origin", _empty()).alias("origin"),
        created.alias("created_at"), F.coalesce(updated, created).alias("updated_at"),
        *[F.array_min(stamp(c)).alias(c) for c in ("first_seen", "last_seen", "last_change")],
        first("role_id").alias("role_id"), first("profile_id").alias("profile_id"),
        F.lit(None if collection_id is None else str(collection_id)).alias("collection_id"),
        ((F.size(flags) > 0) & F.forall(flags, lambda v: v)).alias("mutable"),
        n_values.alias("num_values"), numeric(types).alias("numeric"),
        *[c.alias(g) for g, c in groups.items()], dates.alias("dates"),
        F.map_filter("properties", lambda k, v: k != "indexText").alias("properties"),
        schema_column(lambda s: F.lit(s.bucket)).alias("index_bucket"),
        F.current_timestamp().alias("indexed_at"),
    )


def merge_fragments(entities: DataFrame) -> DataFrame:
    """Rows of one id become one entity: values and context are united, in order of
    value; of several classes the one furthest below stays (ties: by name)."""
    depth = F.create_map(*[x for s in model.SCHEMATA.values() for x in (F.lit(s.name), F.lit(len(s.ancestors)))])
    context = [c for c in entities.columns if c not in ("id", "schema", "properties")]
    top = entities.groupBy("id").agg(
        F.max(F.struct(F.coalesce(F.try_element_at(depth, F.col("schema")), F.lit(0)), F.col("schema"))).getField("schema").alias("schema"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in context],
    )
    each = entities.select("id", F.explode(F.coalesce("properties", F.create_map().cast(VALUES))).alias("k", "v"))
    merged = each.groupBy("id", "k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("v"))
    maps = merged.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("properties"))
    return top.join(maps, "id", "left").select("id", "schema", F.coalesce("properties", F.create_map().cast(VALUES)).alias("properties"), *context)


def signed_id(column: str, dataset: str) -> Column:
    """The id with a signature of its dataset, so that equal ids of several datasets differ."""
    return F.concat(F.col(column), F.lit("."), F.sha1(F.concat(F.lit(f"{dataset}:"), F.col(column))))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
