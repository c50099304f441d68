"""Language identification by the nearest of several centroids of each language.

A text's vector holds its letter n-grams (1 to 3 letters, hashed to ``DIMS``
places) as (1 + ln tf) * idf at unit length. The idf is counted over all
documents. The centroids are found by spherical k-means in each language, from a
bounded sample of trusted documents. A text has the language of the centroid of
the greatest cosine, and is rejected if its distance (1 - cosine) is above what
texts of its length have.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import Positional, pick, table, widened
from .trust import with_trust

DIMS, CENTROIDS, ROUNDS = 8192, 3, 12
#: The centroids are fitted on about so many labelled rows of each language.
SAMPLE_ROWS = 400
#: A distance is too great if it is beyond MARGIN times the greatest of the sample's
#: texts of like length. Texts of fewer letters than MIN_LETTERS aren't rejected for it.
MARGIN, MIN_LETTERS = 1.25, 24
#: So many rows, and about so much text in bytes, are counted at a time: the arrays made
#: from a text take some 70 bytes for each of its own.
_ROWS, _PART = 256, 250_000


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    #: Of each length (its binary logarithm, rounded down) the greatest distance.
    limits: np.ndarray


def counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, letters of each row, matrix of n-gram counts) of parts of the rows."""
    codes, starts = V.code_points(pc.utf8_lower(texts))
    letter = V.class_table("L M")[codes] == 0
    #: Between words one blank is left, and one before each text.
    stays = letter.copy()
    stays[1:] |= letter[:-1]
    edge = starts[:-1][starts[:-1] < len(codes)]
    stays[edge] = letter[edge]
    upto = np.concatenate([[0], np.cumsum(stays)])
    letters = np.diff(np.concatenate([[0], np.cumsum(letter)])[starts])
    x = np.where(letter[stays], codes[stays], 32).astype(np.uint32)
    first = upto[starts]
    back1, back2 = np.empty_like(x), np.empty_like(x)
    back1[1:], back2[2:] = x[:-1], x[:-2]
    back1[:1], back2[:2] = 32, 32
    at = first[:-1][first[:-1] < len(x)]
    back1[at], back2[at] = 32, 32
    at = first[:-1][np.diff(first) > 1] + 1
    back2[at] = 32
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    h = x * np.uint32(0x9E3779B1)
    grams = [h ^ (h >> np.uint32(15))]
    for prior, by in ((back1, 0x85EBCA77), (back2, 0xC2B2AE3D)):
        h = (h ^ (h >> np.uint32(15))) + (prior + np.uint32(7)) * np.uint32(by)
        grams.append(h * np.uint32(0x27D4EB2F))
    grams = [(g * np.uint32(0x165667B1)) >> shift for g in grams]
    for a in range(0, len(texts), _ROWS):
        b = min(a + _ROWS, len(texts))
        lo, hi = first[a], first[b]
        row = np.repeat(np.arange(b - a, dtype=np.int64) * DIMS, np.diff(first[a : b + 1]))
        m = np.zeros((b - a) * DIMS, np.int64)
        for g in grams:
            m += np.bincount(row + g[lo:hi], minlength=len(m))
        yield a, letters[a:b], m.reshape(b - a, DIMS)


def weighed(m: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros(m.shape, np.float32)
    some = m > 0
    out[some] = 1 + np.log(m[some].astype(np.float32))
    out *= idf
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """ln((1 + n) / (1 + n of the documents with the n-gram)) + 1, from all rows of
    ``text`` that have a letter; a table of ``DIMS`` + 1 rows comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for part in V.slices(batch, "text", _PART):
                for _, letters, m in counts(part.column("text")):
                    seen[:DIMS] += (m > 0).sum(0)
                    seen[DIMS] += (letters > 0).sum()
        if seen[DIMS]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(seen)], names=["dim", "n"])

    rows = texts.mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(DIMS + 1)
    for r in rows:
        n[r.dim] = r.n
    return (np.log((1 + n[DIMS]) / (1 + n[:DIMS])) + 1).astype(np.float32)


def _clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from seeds drawn by squared distance (always the same
    draws). Clusters of under a twentieth of the rows go."""
    draw = np.random.default_rng(k)
    centres = [x.mean(0) / max(np.linalg.norm(x.mean(0)), 1e-9)]
    for _ in range(min(k, len(x))):
        far = np.maximum(1 - (x @ np.stack(centres).T).max(1), 1e-9).astype(float) ** 2
        centres.append(x[draw.choice(len(x), p=far / far.sum())])
    c = np.stack(centres[1:])
    for _ in range(ROUNDS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        of = (x @ c.T).argmax(1)
        c = np.stack([x[of == i].sum(0) if (of == i).any() else c[i] for i in range(len(c))])
    n = np.bincount(of, minlength=len(c))
    c = c[n >= max(1, len(x) / 20)]
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def _centroids(x: np.ndarray, own: np.ndarray, languages: list[str], k: int) -> tuple[np.ndarray, list[str]]:
    per = [(g, _clustered(x[own == i], k)) for i, g in enumerate(languages) if (own == i).any()]
    if not per:
        return np.zeros((0, DIMS), np.float32), []
    return np.concatenate([c for _, c in per]).astype(np.float32), [g for g, c in per for _ in range(len(c))]


def _length(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), 40)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, k: int = CENTROIDS) -> Model:
    """From (doc_id, lang, text) and labels. The sample is a share of each
    language's trusted documents by a hash of the id, so that about
    ``sample_rows`` come. Of these, those nearer to another language's mean than to
    their own are left out before clustering."""
    trusted = with_trust(docs, labels).where("trusted and lang is not null")
    share = {r.lang: min(1.0, sample_rows / r.n) for r in trusted.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    idf = inverse_frequencies(pick(docs, "text").select(F.col("text").cast("string")))
    if not share:
        return Model(idf, np.zeros((0, DIMS), np.float32), [], np.ones(41))
    below = F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, int(s * 1_000_000))])
    drawn = trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < below[F.col("lang")]).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "text", _PART):
                ids, langs = part.column("doc_id").to_pylist(), part.column("lang").to_pylist()
                for a, letters, m in counts(part.column("text")):
                    rows = [(ids[a + i], langs[a + i], int(letters[i]), np.flatnonzero(m[i])) for i in np.flatnonzero(letters)]
                    yield pa.RecordBatch.from_pylist(
                        [{"id": str(d), "lang": g, "letters": n, "at": p, "n": m[i, p]} for i, (d, g, n, p) in zip(np.flatnonzero(letters), rows)],
                        pa.schema([("id", pa.string()), ("lang", pa.string()), ("letters", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))]),
                    )

    rows = drawn.mapInArrow(run, "id string, lang string, letters long, at array<int>, n array<int>").collect()
    rows.sort(key=lambda r: (r.lang, r.id, r.letters))
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r.n
    x = weighed(x, idf)
    languages = sorted({r.lang for r in rows})
    own = np.array([languages.index(r.lang) for r in rows])
    means = np.stack([x[own == i].mean(0) for i in range(len(languages))])
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    stays = (x @ means.T).argmax(1) == own
    centroids, names = _centroids(x[stays], own[stays], languages, k)
    #: Distances of rows from centroids they weren't fitted to, half against half.
    half = np.arange(int(stays.sum())) % 2 == 0
    distance = np.zeros(len(half))
    for part in (half, ~half):
        other, _ = _centroids(x[stays][~part], own[stays][~part], languages, k)
        if len(other):
            distance[part] = 1 - (x[stays][part] @ other.T).max(1)
    length = _length(np.array([r.letters for r in rows])[stays])
    #: The longer a text the nearer it is; a length has the limit of the next shorter at most.
    limits = np.full(41, 1.0)
    for i in range(41):
        longer = distance[length >= i]
        limits[i] = min(longer.max() * MARGIN, 1.0) if len(longer) else limits[i - 1]
    return Model(idf, centroids, names, limits)


def judged(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``df``, language__ (null if rejected), distance__."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # DIMS floats a centroid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centroids, names, limits = sent.value
        named = np.array([*names, ""], object)
        for batch in batches:
            for part in V.slices(batch, text, _PART):
                said, far = np.full(part.num_rows, len(names)), np.ones(part.num_rows)
                for a, letters, m in counts(part.column(text)):
                    if not len(centroids):
                        break
                    cosine = weighed(m, idf) @ centroids.T
                    best, d = cosine.argmax(1), np.round(1 - cosine.max(1).astype(float), 4)
                    ok = (letters > 0) & ((letters < MIN_LETTERS) | (d <= limits[_length(letters)]))
                    said[a : a + len(d)], far[a : a + len(d)] = np.where(ok, best, len(names)), d
                gone = said == len(names)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(named[said], pa.string(), mask=gone), pa.array(far)],
                    names=[*part.schema.names, "language__", "distance__"],
                )

    return df.mapInArrow(run, widened(df, language__="string", distance__="double"))


def identify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, language, distance) of every row; language is null where rejected.

    A text without a letter (null, empty, digits) has the distance 1 and is
    rejected; a text of fewer than MIN_LETTERS letters has the nearest language.
    Without any trusted document of a known language every text is rejected. Equal
    texts are judged alike, equal cosines go to the language first in order. Rows
    that repeat stay; other columns are left out, whatever their names."""
    model = model or fit(docs, labels)
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.col("text").cast("string"))
    return judged(rows, model).select("doc_id", F.col("language__").alias("language"), F.col("distance__").alias("distance"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with all their columns; ``lang`` is the
    language found."""
    p = Positional(docs)
    lang, text = p.at("lang"), p.at("text")
    out = judged(p.df.withColumn(text, F.col(text).cast("string")), fit(docs, labels), text).where("language__ is not null")
    return p.restore(out.withColumn(lang, F.col("language__")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that aren't rejected, with the language found."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, table(spark, sf_dir, "labels")).where("language is not null")
