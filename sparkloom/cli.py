"""Command line: ``python -m sparkloom.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.text import analyze_text
from .operators.fulltext import SearchIndex, synonym_groups
from .plans import search
from .plans.params import from_url
from .sources import store, transform


def _print(rows: list[dict]) -> None:
    for row in rows:
        print(json.dumps(row, default=str, ensure_ascii=False))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--table", default="entities", help="path of the table of documents")
    p.add_argument("--synonyms", help="file of rules: words of equal meaning, divided by commas")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("upgrade", "reset", "settings"):
        sub.add_parser(name)
    for name in ("format-entities", "index-entities"):
        c = sub.add_parser(name)
        c.add_argument("dataset")
        c.add_argument("source")
        if name == "format-entities":
            c.add_argument("target")
    c = sub.add_parser("index-actions")
    c.add_argument("source")
    c = sub.add_parser("dump-actions")
    c.add_argument("target")
    c.add_argument("--args", default="")
    c.add_argument("--hidden", action="store_true")
    for name in ("search", "mentions", "multi-mentions", "percolate-text", "percolate-entity", "match", "similar", "nearest"):
        c = sub.add_parser(name)
        c.add_argument("what")
        c.add_argument("--args", default="")
    c = sub.add_parser("body")
    c.add_argument("what", help="a query tree as JSON")
    c = sub.add_parser("delete")
    c.add_argument("--args", required=True)
    c = sub.add_parser("analyze")
    c.add_argument("what")
    c.add_argument("--field", default="content")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "analyze":
        print(json.dumps(analyze_text(a.what, a.field, False), ensure_ascii=False))
        return 0
    if a.command == "settings":
        from .settings import SETTINGS

        print(SETTINGS)
        return 0
    spark = SparkSession.builder.appName("sparkloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    table = store.EntityStore(spark, a.table)
    like = transform.documents(spark.createDataFrame([], transform.ENTITY))
    if a.command == "upgrade":
        table.create(like)
    elif a.command == "reset":
        table.drop()
        table.create(like)
    elif a.command == "format-entities":
        transform.documents(store.read_entities(spark, a.source), a.dataset).write.mode("overwrite").json(a.target)
    elif a.command == "index-entities":
        print(table.index(a.dataset, store.read_entities(spark, a.source)))
    elif a.command == "index-actions":
        print(table.upsert(store.read_actions(spark, a.source, like.schema)))
    elif a.command == "dump-actions":
        q = search.EntitiesQuery(SearchIndex(table.read()), from_url("", a.args))
        tests = list(q.tests().values())
        table.export_actions(a.target, search.P.all_of(tests) if tests else None, a.hidden)
    elif a.command == "delete":
        q = search.EntitiesQuery(SearchIndex(table.read()), from_url("", a.args))
        tests = list(q.tests().values())
        print(table.delete(search.P.all_of(tests)) if tests else 0)
    else:
        index = table.search_index()
        rules = synonym_groups([r.value for r in spark.read.text(a.synonyms).collect()]) if a.synonyms else None
        p = from_url("", getattr(a, "args", ""))
        if a.command == "search":
            found = search.search_query_string(index, a.what, a.args, synonyms=rules)
        elif a.command == "body":
            found = search.search_body(index, json.loads(a.what))
        elif a.command == "mentions":
            found = search.MentionsQuery(index, p, a.what).search()
        elif a.command == "multi-mentions":
            found = search.MultiMentionsQuery(index, p, from_url("", a.what)).search()
        elif a.command == "percolate-text":
            found = search.PercolatorQuery(index, p, text=a.what).search()
        elif a.command == "percolate-entity":
            found = search.PercolatorQuery(index, p, entity_id=a.what).search()
        elif a.command == "match":
            found = search.MatchQuery(index, p, a.what).search()
        elif a.command == "similar":
            found = search.MoreLikeThisQuery(index, p, a.what).search()
        else:
            found = search.GeoDistanceQuery(index, p, a.what).search()
        _print([r.asDict(recursive=True) for r in found.hits.select(*[c for c in found.hits.columns if not c.startswith("index")]).withColumn("id", F.col("_id")).collect()])
    return 0


if __name__ == "__main__":
    sys.exit(main())
