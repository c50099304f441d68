"""The query families: free text with filters, matches, blocking, more like this, nearest, percolation, mentions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import names as N
from ..operators import facets, geo, highlighting, matching, phrases, significant, similar, sorting
from ..operators import predicates as P
from ..operators.fulltext import SearchIndex
from ..settings import SETTINGS
from ..sources.store import fulltext
from ..sources.transform import HIDDEN_COLUMNS
from .params import Params
from .query_string import Node, parse

INCLUDES = {
    "names": ["name", "alias", "previousName", "weakAlias"], "emails": ["email"], "phones": ["phone"], "countries": ["country", "nationality", "citizenship", "jurisdiction"],
    "addresses": ["address", "full"], "identifiers": ["registrationNumber", "taxNumber", "idNumber", "passportNumber", "imoNumber"], "dates": ["date", "birthDate", "startDate", "endDate"],
}


@dataclass
class Result:
    """``hits`` is one page in order; ``matches`` all documents with their scores;
    ``facets`` tables by name, such as ``countries.values``. Nothing is computed
    until one of them is read."""

    hits: DataFrame
    matches: DataFrame
    facets: dict[str, DataFrame] = field(default_factory=dict)

    @cached_property
    def total(self) -> int:
        return self.matches.count()

    def rows(self) -> list[dict]:
        """The page as dictionaries; a page has at most ``max_page`` rows."""
        return [r.asDict(recursive=True) for r in self.hits.collect()]


def boosted(score: Column, docs: DataFrame) -> Column:
    """Score plus a bonus for documents of many values, weighted by bucket."""
    weight = F.lit(1.0)
    for bucket, w in (("pages", SETTINGS.weight_pages), ("documents", SETTINGS.weight_documents), ("intervals", SETTINGS.weight_intervals), ("things", SETTINGS.weight_things)):
        if w != 1:
            weight = F.when(F.col("index_bucket") == bucket, w).otherwise(weight)
    return score + F.sqrt(0.5 * F.coalesce("num_values", F.lit(0))) * weight


class EntitiesQuery:
    """Documents by text, prefix and filters, with facets, order, page, highlights."""

    default_schemata: tuple[str, ...] = ("Thing",)
    prefix_field = "name_parts"

    def __init__(self, index: SearchIndex, params: Params, synonyms: dict[str, list[str]] | None = None, symbols: dict[str, str] | None = None):
        self.index, self.params = index, params
        self.synonyms = synonyms if params.synonyms else None
        self.symbols = symbols or {}

    @cached_property
    def tree(self) -> Node:
        only_pages = self.params.filters.get("schema") == ["Page"]
        return parse(self.params.q, "or" if only_pages else "and")

    @cached_property
    def schemata(self) -> list[str]:
        f = self.params.filters
        return list(f.get("schema") or f.get("schemata") or self.default_schemata)

    # conditions
    def tests(self) -> dict[str, Column]:
        p, docs = self.params, self.index.docs
        out = {f: P.field_terms(docs, f, v) for f, v in p.filters.items()}
        for f, ops in p.ranges.items():
            t = P.field_range(docs, f, ops)
            out[f] = out[f] & t if f in out else t
        return out

    def before(self) -> list[Column]:
        """What limits facets and hits alike: who may read, classes, filters on fields without a facet."""
        docs, p = self.index.docs, self.params
        known = [s for s in self.schemata if s in model.SCHEMATA]
        out = [F.col("index_bucket").isin(model.buckets_of(known))] if known else []
        if "schema" not in p.filters and "schemata" not in p.filters:
            out.append(P.schemata(known, True))
        if p.auth is not None:
            out.append(P.acl(p.auth))
        late = set(p.facets) - {"schema", "schemata"}
        out += [t for f, t in self.tests().items() if f not in late]
        asked = set(p.filters.get("schema", [])) | set(p.filters.get("schemata", []))
        gone = [h for h in model.HIDDEN if h not in asked]
        out.append(~F.col("schema").isin(gone))
        out += [~P.exists(docs, f) for f in p.empties]
        out += [~P.field_terms(docs, f, v) for f, v in p.excludes.items()]
        if p.prefix:
            out.append(P.prefix(docs, self.prefix_field, p.prefix))
        return out

    def after(self) -> dict[str, Column]:
        late = set(self.params.facets) - {"schema", "schemata"}
        return {f: t for f, t in self.tests().items() if f in late}

    def expanded(self, docs: DataFrame, hits: DataFrame) -> DataFrame:
        """Hits, and documents with a name key of two to four words of the text (0.3)
        or a symbol of one of its words (0.5); only where synonyms are asked for."""
        keys = N.name_ngrams(self.params.q)
        marks = sorted({self.symbols[t] for t in N.ascii_text(self.params.q).split() if t in self.symbols})
        for field, values, weight in (("name_keys", keys, 0.3), ("name_symbols", marks, 0.5)):
            if values and field in docs.columns:
                hits = hits.unionByName(docs.where(P.shares(docs, field, values)).select("_id", F.lit(weight).alias("score")))
        return hits.groupBy("_id").agg(F.sum("score").alias("score"))

    def base(self) -> DataFrame:
        """All columns and ``score`` of what passes the conditions before facets."""
        docs = self.index.docs.where(P.all_of(self.before()))
        if self.tree.kind == "all":
            rows = docs.withColumn("score", F.lit(1.0))
        else:
            hits = self.index.search(self.tree, self.synonyms)
            rows = docs.join(self.expanded(docs, hits) if self.params.synonyms else hits, "_id")
        if SETTINGS.function_score and not self.params.is_empty:
            rows = rows.withColumn("score", boosted(F.col("score"), rows))
        return rows

    # parts of the answer
    def facet_tables(self, base: DataFrame) -> dict[str, DataFrame]:
        p, after, out = self.params, self.after(), {}
        for f in p.facets:
            rows = facets.filtered(base, f, after)
            if p.facet_values(f):
                out[f"{f}.values"] = facets.terms(rows, f, p.facet_size(f))
            if p.facet_total(f):
                out[f"{f}.cardinality"] = facets.cardinality(rows, f)
            if interval := p.facet_interval(f):
                _, kind = P.field_column(rows, f)
                ops = p.ranges.get(f, {})
                kind = getattr(kind, "elementType", kind)
                low, high = (next((P.bound(kind, op, ops[op]) for op in pair if op in ops), None) for pair in (("gte", "gt"), ("lte", "lt")))
                out[f"{f}.intervals"] = facets.date_histogram(rows, f, interval, low, high, p.metrics)
        matches = base.where(P.all_of(list(after.values())))
        if p.metrics:
            out["metrics"] = facets.metrics(matches, p.metrics)
        if p.significant or p.significant_text is not None:
            background = self.background()
            how = SETTINGS.significant_sampler
            for f in p.significant:
                drawn = significant.sample(facets.filtered(base, f, after), how, SETTINGS.significant_sample_size)
                least = 1 if how == "random" else SETTINGS.significant_min_doc_count
                if p.significant_values(f):
                    out[f"{f}.significant_terms"] = significant.terms(drawn, background, f, p.significant_size(f), least)
                    if p.significant_type(f) == "nested":
                        out[f"{f}.significant_nested"] = significant.nested(drawn, background, f, p.significant_size(f), least)
                if p.significant_total(f):
                    out[f"{f}.significant_cardinality"] = facets.cardinality(drawn, f)
            if (f := p.significant_text) is not None:
                sampler = "top" if p.datasets else "diversified"
                drawn = significant.sample(matches, sampler, SETTINGS.significant_text_sample_size)
                out[f"{f}.significant_text"] = significant.text(drawn, background, f, p.significant_text_size, p.significant_text_min_doc_count)
        return out

    def background(self) -> DataFrame:
        """Documents of the collections asked for, else of the datasets, else all."""
        p, docs = self.params, self.index.docs
        if p.collection_ids:
            return docs.where(F.col("collection_id").isin(sorted(map(str, p.collection_ids))))
        return docs.where(F.col("dataset").isin(sorted(p.datasets))) if p.datasets else docs

    def project(self, hits: DataFrame) -> DataFrame:
        """What a hit returns: no index columns; without properties on request, but those included."""
        kept = [c for c in hits.columns if c not in HIDDEN_COLUMNS]
        if not self.params.dehydrate:
            return hits.select(*kept)
        wanted = [x for f in self.params.include_fields for x in INCLUDES.get(f, [f])]
        if not wanted:
            return hits.select(*[c for c in kept if c != "properties"])
        return hits.select(*kept).withColumn("properties", F.map_filter("properties", lambda k, _: k.isin(wanted)))

    def sorts(self) -> list[tuple[str, str]]:
        return self.params.sorts

    def finish(self, base: DataFrame) -> Result:
        p = self.params
        matches = base.where(P.all_of(list(self.after().values())))
        limit = 0 if p.significant or p.significant_text is not None else p.limit
        sorts = self.sorts()
        hits = sorting.page(matches, sorts, p.offset, limit)
        if p.highlight:
            more = [v for f in ("names", "addresses", "identifiers", "emails", "ips", "phones", "name") for v in p.filters.get(f, [])]
            hits = highlighting.highlight(hits, self.tree, p.highlight_count, self.synonyms, more)
            hits = hits.orderBy(*sorting.sort_columns(hits, sorts))
        return Result(self.project(hits), matches, self.facet_tables(base))

    def search(self) -> Result:
        return self.finish(self.base())


class _Scored(EntitiesQuery):
    """A family whose own condition is a table (_id, score, ...) joined to the documents."""

    def scores(self) -> DataFrame:
        raise NotImplementedError

    def base(self) -> DataFrame:
        rows = super().base().withColumnRenamed("score", "text_score")
        own = self.scores()
        return rows.join(own.withColumnRenamed("score", "own_score"), "_id").withColumn("score", F.col("text_score") + F.col("own_score")).drop("text_score", "own_score")

    def sorts(self) -> list[tuple[str, str]]:
        return self.params.sorts or [("score", "desc")]


def _one(index: SearchIndex, entity: str | DataFrame) -> DataFrame:
    """A single source, by its id or as a table of one document."""
    return entity if isinstance(entity, DataFrame) else index.docs.where(F.col("_id") == entity)


class MatchQuery(_Scored):
    """Entities that may be the same as the given one."""

    def __init__(self, index: SearchIndex, params: Params, entity: str | DataFrame, exclude: list[str] | None = None, datasets: list[str] | None = None):
        super().__init__(index, params)
        self.entity, self.exclude, self.only = _one(index, entity), exclude or [], datasets

    def before(self) -> list[Column]:
        out = super().before()
        if self.exclude:
            out.append(~F.col("_id").isin(self.exclude))
        return out + ([F.col("dataset").isin(self.only)] if self.only else [])

    def scores(self) -> DataFrame:
        return matching.matches(self.entity, self.index.docs).select("_id", "score")

    def sorts(self) -> list[tuple[str, str]]:
        return [("score", "desc")]


def blocking_query(index: SearchIndex, entity: str | DataFrame, datasets: list[str] | None = None) -> DataFrame:
    """Ids that share a blocking key with the entity, without scores."""
    docs = index.docs.where(F.col("dataset").isin(datasets)) if datasets else index.docs
    return matching.blocking_candidates(_one(index, entity), docs).select("_id")


class MoreLikeThisQuery(_Scored):
    """Documents like the given one."""

    default_schemata = ("Document",)

    def __init__(self, index: SearchIndex, params: Params, entity: str, exclude: list[str] | None = None, datasets: list[str] | None = None):
        super().__init__(index, params)
        self.entity, self.exclude, self.only = entity, exclude or [], datasets

    def before(self) -> list[Column]:
        out = [*super().before(), ~F.col("_id").isin([self.entity, *self.exclude])]
        return out + ([F.col("dataset").isin(self.only)] if self.only else [])

    def scores(self) -> DataFrame:
        limits = dict(self.params.similar)
        minimum = limits.pop("minimum")
        return similar.more_like(self.index, _one(self.index, self.entity), minimum, **limits).select("_id", "score")

    def sorts(self) -> list[tuple[str, str]]:
        return [("score", "desc")]


class GeoDistanceQuery(EntitiesQuery):
    """Documents with a point, nearest to the given one first; none if that has no point."""

    def __init__(self, index: SearchIndex, params: Params, entity: str, exclude: list[str] | None = None):
        super().__init__(index, params)
        self.entity, self.exclude = entity, exclude or []

    def base(self) -> DataFrame:
        point = _one(self.index, self.entity).select(F.get("geo_point", F.lit(0)).alias("p")).where("p is not null").first()
        if point is None:
            return super().base().withColumn("distance_km", F.lit(None).cast("double")).where(F.lit(False))
        return geo.nearest(super().base(), point.p.lon, point.p.lat, [self.entity, *self.exclude])

    def sorts(self) -> list[tuple[str, str]]:
        return [("distance_km", "asc")]


class PercolatorQuery(_Scored):
    """Entities that a text mentions; the text is given, or that of a document."""

    def __init__(self, index: SearchIndex, params: Params, text: str | None = None, entity_id: str | None = None):
        if (text is None) == (entity_id is None):
            raise ValueError("exactly one of text and entity_id")
        super().__init__(index, params)
        if entity_id is not None:
            row = index.docs.where((F.col("_id") == entity_id) & F.col("schema").isin(list(model.schema("Document").descendants))).select(fulltext().alias("t")).first()
            if row is None or not row.t:
                raise ValueError(f"No percolatable fulltext: {entity_id}")
            text = row.t
        self.text = text

    def scores(self) -> DataFrame:
        spark = self.index.spark
        texts = spark.createDataFrame([("text", self.text)], "_id string, content string")
        if not SETTINGS.percolation:
            texts = texts.limit(0)
        names = phrases.names_of(self.index.docs.where(F.col("index_bucket") == "things"))
        found = phrases.percolate(names, texts)
        return found.select(F.col("entity_id").alias("_id"), "score", F.col("tags").alias("percolator_match"), "fired")

    def finish(self, base: DataFrame) -> Result:
        """``surface_forms`` are the places of the text as they are written there, from the
        marked passages; without highlights there are none."""
        out = super().finish(base)
        hits = out.hits.drop("highlight")
        if not self.params.highlight:
            hits = hits.withColumn("surface_forms", F.array().cast("array<string>"))
        else:
            marked = highlighting.phrase_passages(hits.withColumn("content", F.lit(self.text)), "fired", self.params.highlight_count)
            hits = marked.drop("content").orderBy(*sorting.sort_columns(marked, self.sorts()))
        return replace(out, hits=hits.drop("fired"))


def _with_mentions_marked(query: _Scored, out: Result) -> Result:
    """Hits whose passages have the mentioned names marked, each as a whole."""
    if not query.params.highlight:
        return out
    hits = out.hits.drop("highlight")
    names = query.names.select("entity_id", "name").distinct()
    own = hits.select("_id", F.explode("mention_sources").alias("entity_id")).join(names, "entity_id").groupBy("_id").agg(F.collect_set("name").alias("fired"))
    text = query.index.docs.select("_id", "content").join(F.broadcast(hits.select("_id")), "_id", "left_semi")  # a page
    marked = highlighting.phrase_passages(hits.drop("content").join(own, "_id").join(text, "_id"), "fired", query.params.highlight_count, no_match=SETTINGS.highlight_no_match)
    hits = marked.drop("fired", "content").orderBy(*sorting.sort_columns(marked, query.sorts()))
    return replace(out, hits=hits)


class MentionsQuery(_Scored):
    """Documents that mention one entity."""

    default_schemata = ("Document",)

    def __init__(self, index: SearchIndex, params: Params, entity_id: str):
        if not entity_id:
            raise ValueError("entity_id is needed")
        super().__init__(index, params)
        source = _one(index, entity_id)
        if source.limit(1).count() == 0:
            raise ValueError(f"entity {entity_id!r} not found")
        self.names = phrases.names_of(source)
        if self.names.limit(1).count() == 0:
            raise ValueError(f"entity {entity_id!r} has no matchable names")
        self.sources = source.select("_id")

    def scores(self) -> DataFrame:
        found = phrases.mentions(self.names, self.index)
        return found.join(F.broadcast(self.sources), "_id", "left_anti")  # one id

    def finish(self, base: DataFrame) -> Result:
        return _with_mentions_marked(self, super().finish(base))


class MultiMentionsQuery(_Scored):
    """Documents that mention any entity of a second request, with which they do."""

    default_schemata = ("Document",)

    def __init__(self, index: SearchIndex, params: Params, source_params: Params, max_names: int | None = None):
        super().__init__(index, params)
        found = EntitiesQuery(index, replace(source_params, default_limit=0)).base()
        self.names = phrases.names_of(found).where("tag = 'name'")
        max_names = SETTINGS.mention_names if max_names is None else max_names
        if max_names:  # 0 is no limit
            n = self.names.limit(max_names + 1).count()
            if n > max_names:
                raise ValueError(f"Source filter matched more than {max_names} names")

    def scores(self) -> DataFrame:
        return phrases.mentions(self.names, self.index)

    def finish(self, base: DataFrame) -> Result:
        return _with_mentions_marked(self, super().finish(base))


def search_query_string(index: SearchIndex, q: str, args: str = "", auth: model.Auth | None = None, synonyms: dict[str, list[str]] | None = None) -> Result:
    from .params import from_url

    return EntitiesQuery(index, from_url(q, args, auth), synonyms).search()


def _text_node(kind: str, spec: dict) -> Node:
    if kind == "query_string":
        return parse(spec["query"], spec.get("default_operator", "and").lower())
    (f, v), *_ = spec.items()
    text = v["query"] if isinstance(v, dict) else v
    return Node("phrase" if kind == "match_phrase" else "words", f, text, int(v.get("slop", 0)) if isinstance(v, dict) else 0)


def search_body(index: SearchIndex, body: dict, sorts: list[tuple[str, str]] | None = None) -> Result:
    """A query tree of the caller's own, with texts anywhere in it. A document's score
    is the sum of those of its texts; without a text in the tree each has 1."""
    query = body.get("query", {"match_all": {}})
    rows, marks = index.docs, []

    def text(kind: str, spec: dict) -> Column:
        nonlocal rows
        mark = f"text{len(marks)}__"
        marks.append(mark)
        rows = rows.join(index.search(_text_node(kind, spec)).withColumnRenamed("score", mark), "_id", "left")
        return F.col(mark).isNotNull()

    test = P.from_body(index.docs, query, text)
    score = sum((F.coalesce(m, F.lit(0.0)) for m in marks), F.lit(0.0)) if marks else F.lit(1.0)
    rows = rows.where(test).withColumn("score", score).drop(*marks)
    hits = sorting.page(rows, sorts or [], body.get("from", 0), body.get("size", SETTINGS.query_limit))
    return Result(hits, rows)


def to_text(params: Params) -> str:
    """A request in the words of the query language."""
    parts = [params.q] if params.q else []
    parts += [P.filter_text(f, v) for f, v in sorted(params.filters.items())]
    parts += [P.filter_text(f, v, True) for f, v in sorted(params.excludes.items())]
    parts += [P.filter_text(f, [], True) for f in params.empties]
    return " AND ".join(parts) or "*"
