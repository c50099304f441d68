"""Queries that take every row as a source, against brute force on small tables."""

import math
import re
from collections import Counter

import pytest

from sparkloom import model
from sparkloom.operators import matching
from sparkloom.queries import QUERIES, part_docs

PARTS = [
    (1, "stephen smith", "Alpha", "LARGE TOOL KIND", 1001.25), (2, "steven smyth", "Beta", "LARGE TOOL KIND", 1001.25), (3, "hot bolt", "Brand#1", "SMALL", 12.5), (4, "bolt hot", "Brand#1", "SMALL", 99.0),
    (5, "hot gear", "Brand#1", "PROMO", 12.5), (6, "cold ring", "Gamma", "PROMO", 7.0), (7, "cold ring", "Gamma", "MEDIUM SIZED KIND", 1234567.5), (8, "lonely", "Quux", "MEDIUM SIZED KIND", 1234567.5),
]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("parts"))
    spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double").write.parquet(f"{at}/part.parquet")
    return at, {int(r._id): r for r in part_docs(spark, at).collect()}


def test_matches_of_every_part(spark, parts):
    at, docs = parts
    types = model.property_types()

    def extra(a, b):
        total = 0.0
        for prop, values in a.properties.items():
            kind = types.get(prop)
            if kind is None or kind == "name" or kind in model.UNINDEXED_TYPES:
                continue
            for v in set(values) & set(b.properties.get(prop) or []):
                if kind == "identifier":
                    total += 3.0
                elif kind in matching.STRONG:
                    total += matching.STRONG[kind]
                elif kind in ("country", "topic", "gender", "language", "mimetype"):
                    total += 0.1
                else:
                    total += max(0.0, min(1.0, (len(v) - 3) / 9))
        return total

    want = {}
    for i, a in docs.items():
        for j, b in docs.items():
            score = 0.0
            for field, (weight, least) in matching.NAME_CLAUSES.items():
                mine = set(a[field] or [])
                n = len(mine & set(b[field] or []))
                if i != j and n and n >= min(least, len(mine)):
                    score += weight * (1 if field == "names" else n)
            if score:
                want[str(i), str(j)] = 1 + score + extra(a, b)
    got = {(r.source_id, r._id): r.score for r in QUERIES["match_entity"](spark, at).collect()}
    assert got == pytest.approx(want, abs=1e-3)
    assert len({a for a, _ in got}) >= 6 and ("3", "4") in got and ("1", "2") in got


def test_blocking_by_every_key(spark, parts):
    at, docs = parts
    keys = {i: {(f, v) for f in matching.BLOCKING for v in r[f] or []} for i, r in docs.items()}
    want = {(a, b) for a in docs for b in docs if str(a) < str(b) and keys[a] & keys[b]}
    rows = [(r.a, r.b) for r in QUERIES["blocking_pairs_all"](spark, at).collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert (1, 2) in want and (1, 2) not in {(r.a, r.b) for r in QUERIES["blocking_pairs"](spark, at).collect()}


def test_more_like_every_document(spark, tmp_path):
    base = "harbour cargo manifest northern shipping company contract signed yesterday"
    texts = [base, base + " again", "cargo shipping report about northern weather", "nothing common whatsoever", "weather report yesterday evening", "tiny", "manifest manifest cargo"]
    rows = [(i, "s", t, "en", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    tf = [Counter(re.findall(r"\w+", t)) for t in texts]
    df = Counter(w for c in tf for w in c)
    n, mean = len(tf), sum(sum(c.values()) for c in tf) / len(tf)

    def bm25(w, j):
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[j][w] / (tf[j][w] + 1.2 * (0.25 + 0.75 * sum(tf[j].values()) / mean))

    want = {}
    for i in range(n):
        weight = {w: c * (1 + math.log(n / (df[w] + 1))) for w, c in tf[i].items() if len(w) >= 5}
        for j in range(n):
            both = [w for w in weight if w in tf[j]]
            if i != j and len(both) >= max(1, math.floor(len(weight) * 0.1)):
                want[i, j] = (sum(bm25(w, j) * weight[w] for w in both) / max(weight.values()), len(both))
    got = {(r.source_id, r.doc_id): (r.score, r.matched) for r in QUERIES["more_like_all"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len({i for i, _ in got}) >= 5
    for k, (score, matched) in want.items():
        assert got[k] == (pytest.approx(score, abs=1e-4), matched)
