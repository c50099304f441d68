"""Quality rules by distribution divergence.

A document's histogram of character classes, and that of its language's most
common words, are compared with the language's reference by Jensen-Shannon
distance (base 2, from 0 to 1). The references are made from all trusted
documents of the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import vectext as V
from .common import Positional, cut, pick, table, widened
from .trust import with_trust

#: Prefixes of Unicode general categories; what is left is a class of its own.
CLASSES = ("Ll", "Lu", "L M", "N", "P", "S", "Z Cc")
COMMON_WORDS = 32
#: Texts of fewer characters or words aren't judged by the histogram in question.
MIN_CHARS, MIN_WORDS = 100, 60
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.2, 0.5
#: Limits by length are this quantile of trusted texts of like length (the binary
#: logarithm, rounded down). A length of fewer than LEAST_ROWS of them has the limit
#: of the next shorter; where there is none, the constant above.
QUANTILE, LEAST_ROWS, LENGTHS = 0.999, 200, 64
WORD = r"[\p{L}\p{N}]+"


def class_counts(texts: pa.Array) -> np.ndarray:
    codes, starts = V.code_points(texts)
    of = V.class_table(*CLASSES)[codes].astype(np.int64)
    n = len(CLASSES) + 1
    of += np.repeat(np.arange(len(texts), dtype=np.int64) * n, np.diff(starts))
    return np.bincount(of, minlength=len(texts) * n).reshape(-1, n)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q."""

    def half(a: np.ndarray, m: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0).sum(1)

    q = np.broadcast_to(q, p.shape)
    m = (p + q) / 2
    return np.sqrt(np.maximum((half(p, m) + half(q, m)) / 2, 0))


def references(trusted: DataFrame, words: int = COMMON_WORDS) -> dict[str, tuple[np.ndarray, list[str], np.ndarray]]:
    """Of each language (a null one is ''): shares of the character classes; the
    most common words, ties in order of the word; their shares and that of all
    others. From every row (lang, text); a few dozen rows a language come back."""
    n = len(CLASSES) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = pc.dictionary_encode(batch.column("lang"))
            sums = np.zeros((len(langs.dictionary), n), np.int64)
            np.add.at(sums, langs.indices.to_numpy(), class_counts(batch.column("text")))
            cols = {f"k{i}": sums[:, i] for i in range(n)}
            yield pa.RecordBatch.from_arrays([langs.dictionary, *map(pa.array, cols.values())], names=["lang", *cols])

    named = trusted.select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    classes = named.mapInArrow(count, "lang string, " + ", ".join(f"k{i} long" for i in range(n)))
    classes = classes.groupBy("lang").agg(*[F.sum(f"k{i}").alias(f"k{i}") for i in range(n)]).collect()
    seen = cut(  # read twice
        named.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n")),
        "words",
    )
    top = seen.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= words)
    top = top.orderBy("lang", "k").collect()
    total = {r.lang: r.n for r in seen.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    out = {}
    for r in classes:
        k = np.array(r[1:], float)
        mine = [(x.word, x.n) for x in top if x.lang == r.lang]
        if k.sum() and mine:
            share = np.array([c for _, c in mine], float) / total[r.lang]
            out[r.lang] = (k / k.sum(), [w for w, _ in mine], np.append(share, max(0.0, 1 - share.sum())))
    return out


def _at(most: float | np.ndarray, length: np.ndarray) -> float | np.ndarray:
    """The limit of each length; a number is that of all lengths."""
    return most[np.log2(np.maximum(length, 1)).astype(np.int64)] if isinstance(most, np.ndarray) else most


def length_limits(trusted: DataFrame, refs: dict, quantile: float = QUANTILE, least_rows: int = LEAST_ROWS) -> dict[str, np.ndarray]:
    """``max_class`` and ``max_word`` of each length, counted over every row (lang,
    text). A row a length and rule comes back."""
    scored = judged(trusted.select("lang", F.col("text").cast("string").alias("text")), refs)
    one = lambda rule, n, d: F.struct(F.lit(rule).alias("rule"), (F.length(F.bin(n)) - 1).alias("length"), F.col(d).alias("d"))
    each = scored.select(F.explode(F.array(one("max_class", "n_letters__", "class_distance__"), one("max_word", "n_words__", "word_distance__"))).alias("x"))
    found = each.where("x.d is not null").groupBy("x.rule", "x.length").agg(F.percentile_approx("x.d", quantile, 100_000).alias("q"), F.count("*").alias("n"))
    known = {(r.rule, r.length): r.q for r in found.collect() if r.n >= least_rows}
    out = {"max_class": np.full(LENGTHS, MAX_CLASS_DISTANCE), "max_word": np.full(LENGTHS, MAX_WORD_DISTANCE)}
    for rule, most in out.items():
        for i in range(LENGTHS):
            most[i] = known.get((rule, i), most[max(i - 1, 0)])
    return out


def judged(
    df: DataFrame, refs: dict, text: str = "text", lang: str = "lang", min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
    max_class: float | np.ndarray = MAX_CLASS_DISTANCE, max_word: float | np.ndarray = MAX_WORD_DISTANCE,
) -> DataFrame:
    """All columns of ``df`` and n_letters__, n_words__, class_distance__,
    word_distance__, keep__; see ``keep``. A limit is one number, or one for each
    length (``length_limits``)."""
    n = len(CLASSES) + 1
    every = sorted({w for _, words, _ in refs.values() for w in words})
    codes, starts = V.code_points(pa.array(every, pa.string()))
    hashes = V.span_hashes(codes, starts[:-1], starts[1:])
    order = np.argsort(hashes)
    table_, place = hashes[order], {every[i]: k for k, i in enumerate(order)}
    made = {k: (c, np.array([place[w] for w in words]), s) for k, (c, words, s) in refs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, text):
                texts, rows = part.column(text), part.num_rows
                classes = class_counts(texts)
                chars = classes.sum(1)
                c, s = V.code_points(pc.utf8_lower(texts))
                begin, end, first = V.word_spans(c, s)
                words = np.diff(first)
                found = np.full((rows, len(table_)), 0.0)
                if len(table_) and len(begin):
                    h = V.span_hashes(c, begin, end)
                    at = np.minimum(np.searchsorted(table_, h), len(table_) - 1)
                    hit = table_[at] == h
                    of = np.repeat(np.arange(rows), words)[hit]
                    found = np.bincount(of * len(table_) + at[hit], minlength=rows * len(table_)).reshape(rows, -1).astype(float)
                cd, wd = np.full(rows, np.nan), np.full(rows, np.nan)
                langs = pc.dictionary_encode(pc.fill_null(part.column(lang), ""))
                for k, name in enumerate(langs.dictionary.to_pylist()):
                    if name not in made:
                        continue
                    ref_c, cols, ref_w = made[name]
                    mine = langs.indices.to_numpy() == k
                    r = np.flatnonzero(mine & (chars >= min_chars))
                    cd[r] = distance(classes[r] / chars[r, None], ref_c)
                    r = np.flatnonzero(mine & (words >= min_words))
                    p = found[np.ix_(r, cols)]
                    p = np.column_stack([p, words[r] - p.sum(1)]) / words[r, None]
                    wd[r] = distance(p, ref_w)
                cd, wd = np.round(cd, 6), np.round(wd, 6)
                ok = ~((cd > _at(max_class, chars)) | (wd > _at(max_word, words))) & (chars > 0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(chars), pa.array(words), pa.array(cd, from_pandas=True), pa.array(wd, from_pandas=True), pa.array(ok)],
                    names=[*part.schema.names, "n_letters__", "n_words__", "class_distance__", "word_distance__", "keep__"],
                )

    return df.mapInArrow(run, widened(df, n_letters__="long", n_words__="long", class_distance__="double", word_distance__="double", keep__="boolean"))


def keep(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The documents that pass, with all their columns.

    A document goes if the distance of its character classes, or of its common
    words, to the reference of its language is above the limit of its length (from
    trusted documents, unless given), or if its text is null or empty. A text below the minimum length of a rule passes that rule, as
    does one of a language without trusted documents. Rows that repeat are judged
    alike; a null language is a language of its own."""
    p = Positional(docs)
    trusted = with_trust(docs, labels).where("trusted").select("lang", "text")
    refs = references(trusted)
    limits = length_limits(trusted, refs) | limits
    out = judged(p.df.withColumn(p.at("text"), F.col(p.at("text")).cast("string")), refs, p.at("text"), p.at("lang"), **limits)
    return p.restore(out.where("keep__"))


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass, with their lengths and distances (null below the
    minimum length)."""
    docs = table(spark, sf_dir, "documents")
    refs = references(with_trust(docs, table(spark, sf_dir, "labels")).where("trusted").select("lang", "text"))
    return judged(pick(docs, "doc_id", "lang", "text"), refs).where("keep__").select(
        "doc_id", "lang", F.col("n_letters__").alias("n_chars"), F.col("n_words__").alias("n_words"),
        F.col("class_distance__").alias("class_distance"), F.col("word_distance__").alias("word_distance"),
    )


def op2_quality_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2_quality_divergence`` with the limits of each length."""
    docs = table(spark, sf_dir, "documents")
    trusted = with_trust(docs, table(spark, sf_dir, "labels")).where("trusted").select("lang", "text")
    refs = references(trusted)
    return judged(pick(docs, "doc_id", "lang", "text"), refs, **length_limits(trusted, refs)).where("keep__").select(
        "doc_id", "lang", F.col("n_letters__").alias("n_chars"), F.col("n_words__").alias("n_words"),
        F.col("class_distance__").alias("class_distance"), F.col("word_distance__").alias("word_distance"),
    )


def oracle_sql() -> str:
    only = lambda c: f"len(regexp_replace(text, '[^{c}]', '', 'g'))"
    k = [only(r"\p{Ll}"), only(r"\p{Lu}"), f"{only(r'\p{L}\p{M}')} - {only(r'\p{Ll}\p{Lu}')}", *(only(rf"\p{{{c}}}") for c in "NPS"), only(r"\p{Z}\p{Cc}")]
    js = "sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0))"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS l, lang, text, len(text) AS n_chars FROM documents),
    good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY 1 HAVING bool_and(coalesce(quality = 1, false) AND coalesce(toxic = 0, false))),
    kinds AS (
      SELECT doc_id, l, n_chars, unnest([{", ".join(f"'{i}'" for i in range(len(k)))}, 'rest']) AS kind,
             unnest([{", ".join(f"c{i}" for i in range(len(k)))}, n_chars - ({" + ".join(f"c{i}" for i in range(len(k)))})]) AS n
      FROM (SELECT *, {", ".join(f"{x} AS c{i}" for i, x in enumerate(k))} FROM d)),
    kind_ref AS (SELECT l, kind, sum(n) / sum(sum(n)) OVER (PARTITION BY l) AS q FROM kinds SEMI JOIN good USING (doc_id) GROUP BY 1, 2),
    kind_dist AS (
      SELECT doc_id, round({js}, 6) AS cd FROM (SELECT doc_id, n / n_chars AS p, q FROM kinds JOIN kind_ref USING (l, kind) WHERE n_chars >= {MIN_CHARS}) GROUP BY 1),
    words AS (SELECT doc_id, l, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM d),
    n_words AS (SELECT doc_id, count(*) AS n_words FROM words GROUP BY 1),
    seen AS (SELECT l, word, count(*) AS n FROM words SEMI JOIN good USING (doc_id) GROUP BY 1, 2),
    shares AS (SELECT *, n / sum(n) OVER (PARTITION BY l) AS q, row_number() OVER (PARTITION BY l ORDER BY n DESC, word) AS k FROM seen),
    word_ref AS (
      SELECT l, word, q FROM shares WHERE k <= {COMMON_WORDS}
      UNION ALL SELECT l, '' AS word, greatest(0, 1 - sum(q)) AS q FROM shares WHERE k <= {COMMON_WORDS} GROUP BY 1),
    hits AS (SELECT doc_id, word, count(*) AS n FROM words JOIN word_ref USING (l, word) GROUP BY 1, 2),
    found AS (SELECT * FROM hits UNION ALL SELECT doc_id, '' AS word, n_words - coalesce((SELECT sum(n) FROM hits h WHERE h.doc_id = w.doc_id), 0) AS n FROM n_words w),
    word_dist AS (
      SELECT doc_id, round({js}, 6) AS wd
      FROM (SELECT d.doc_id, coalesce(found.n, 0) / n_words AS p, q FROM d JOIN n_words USING (doc_id) JOIN word_ref USING (l)
            LEFT JOIN found ON found.doc_id = d.doc_id AND found.word = word_ref.word WHERE n_words >= {MIN_WORDS}) GROUP BY 1)
    SELECT doc_id, lang, n_chars, coalesce(n_words, 0) AS n_words, cd AS class_distance, wd AS word_distance
    FROM d LEFT JOIN n_words USING (doc_id) LEFT JOIN kind_dist USING (doc_id) LEFT JOIN word_dist USING (doc_id)
    WHERE n_chars > 0 AND NOT coalesce(cd > {MAX_CLASS_DISTANCE}, false) AND NOT coalesce(wd > {MAX_WORD_DISTANCE}, false)
    """
