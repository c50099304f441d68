"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

One model of character n-grams for each language, trained on trusted text (Chen
and Goodman, 1999: three discounts an order, continuation counts below the
highest order). The counts are tables sharded by n-gram; each order's
probabilities are joins of its counts with those of its histories and with the
probabilities of the order below. A document goes if its perplexity is above its
language's limit, a quantile over trusted documents the model hasn't seen.

Space runs are one space, digits are 0. Each text begins with ORDER - 1 marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import vectext as V
from .common import Positional, cut, drop_cut, pick, table, widened
from .trust import with_trust

ORDER = 5
#: One trusted document in HELD isn't trained on; the quantile is over these.
HELD = 5
QUANTILE, MARGIN = 0.99, 1.02
#: A text counts as if so many more characters of its language's mean came with it,
#: so that a short text needs more evidence than it can give to be rejected.
PRIOR = 64
#: A model of up to so many rows comes to the driver (24 bytes each, 48 MB) and is sent
#: to the executors; a larger one is joined with the documents' n-grams, by blocks of
#: so much text, with the same result.
SENT_ROWS, BLOCK = 2_000_000, 16 << 20
MARK, SPACE, DIGIT = 2, 32, 48
#: So much text is counted, or scored, at a time, in bytes; a longer text by itself.
COUNTED, SCORED = 1_500_000, 400_000


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols in a row, marks included, and where each text's start."""
    codes, starts = V.code_points(texts)
    kind = V.class_table("N", "Z Cc")[codes]
    x = np.where(kind == 0, np.uint32(DIGIT), np.where(kind == 1, np.uint32(SPACE), codes))
    space = kind == 1
    stays = ~space
    stays[1:] |= ~space[:-1]
    edge = starts[:-1][starts[:-1] < len(x)]
    stays[edge] = ~space[edge]
    n = np.diff(np.concatenate([[0], np.cumsum(stays)])[starts])
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n + ORDER - 1, out=begin[1:])
    out = np.full(begin[-1], MARK, np.uint32)
    at = np.arange(n.sum()) + np.repeat(begin[:-1] + ORDER - 1 - (np.cumsum(n) - n), n)
    out[at] = x[stays]
    return out, begin


def _places(begin: np.ndarray) -> np.ndarray:
    """Where the symbols are that get a probability: all but the marks."""
    n = np.diff(begin) - (ORDER - 1)
    return np.arange(n.sum()) + np.repeat(begin[:-1] + ORDER - 1 - (np.cumsum(n) - n), n)


def _language(lang: str) -> int:
    return int(V.span_hashes(np.frombuffer(f"<{lang}>".encode("utf-32-le"), np.uint32), np.array([0]), np.array([len(lang) + 2]))[0])


def keys(x: np.ndarray, at: np.ndarray, k: int, seed: np.ndarray) -> np.ndarray:
    """63-bit key of the k symbols that end at each place; 0 symbols have one too."""
    h = seed + V.U64(k + 1)
    for i in range(k):
        h = h * V.U64(V.STEP) + x[at - i].astype(V.U64) + V.U64(1)
        h ^= h >> V.U64(29)
    return V.mix(h) >> V.U64(1)


def _key_of(lang: str, gram: str) -> int:
    x = np.frombuffer(gram.encode("utf-32-le"), np.uint32)
    return int(keys(x, np.array([len(x) - 1]), len(x), np.array([_language(lang)], V.U64))[0])


def _seeds(langs: pa.Array) -> np.ndarray:
    """The hash of each row's language; a null one is that of empty name."""
    d = pc.dictionary_encode(pc.fill_null(langs, ""))
    each = np.array([_language(g) for g in d.dictionary.to_pylist()], V.U64)
    return each[d.indices.to_numpy()] if len(each) else each


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of the highest order, counted over all rows (lang, text):
    in each part of a batch first, then by n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "text", COUNTED):
                x, begin = symbols(part.column("text"))
                d = pc.dictionary_encode(pc.fill_null(part.column("lang"), ""))
                at = _places(begin)
                of = np.repeat(d.indices.to_numpy(), np.diff(begin) - (ORDER - 1))
                for i, lang in enumerate(d.dictionary.to_pylist()):
                    mine = at[of == i]
                    _, first, n = np.unique(keys(x, mine, ORDER, np.zeros(len(mine), V.U64)), return_index=True, return_counts=True)
                    if len(n):
                        window = np.maximum(x, 1)[mine[first][:, None] + np.arange(1 - ORDER, 1)]
                        grams = np.ascontiguousarray(window).view(f"<U{ORDER}").ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(n), pa.string()), pa.array(grams, pa.string()), pa.array(n.astype(np.int64))],
                            names=["lang", "gram", "n"],
                        )

    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> Column:
    """The three discounts of an order, each language's own, for a count ``n``."""
    some = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    known: dict[str, list[float]] = {}
    for r in counts.groupBy("lang").agg(*some).collect():
        y = r.n1 / (r.n1 + 2 * r.n2) if r.n1 + r.n2 else 0.5
        d = [i - (i + 1) * y * r[f"n{i + 1}"] / r[f"n{i}"] if r[f"n{i}"] else 0.5 * i for i in (1, 2, 3)]
        known[r.lang] = [min(max(v, 0.1 * i), 0.9 * i) for i, v in zip((1, 2, 3), d)]
    if not known:
        return F.array(F.lit(0.5), F.lit(1.0), F.lit(1.5))
    return F.create_map(*[x for g, d in known.items() for x in (F.lit(g), F.array(*map(F.lit, d)))])[F.col("lang")]


def train(rows: DataFrame) -> DataFrame:
    """(lang, gram, p, g): ln of the probability of each n-gram's last symbol after
    the others, of all orders, and ln of the weight of the order below after it as a
    history (0 where it was never one). The n-gram of no symbol has the
    probability of a symbol never seen, and the weight of it."""
    counts = {ORDER: cut(gram_counts(rows), "grams")}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = cut(counts[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "grams")
    sizes = counts[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p"))
    below = sizes.select("lang", F.lit("").alias("gram"), "p")
    out, made = None, []
    for k in range(1, ORDER + 1):
        discount = counts[k].withColumn("h", F.substring("gram", 1, k - 1) if k > 1 else F.lit("")).withColumn("d3", _discounts(counts[k]))
        taken = discount.withColumn("d", F.get("d3", F.least("n", F.lit(3)).cast("int") - 1))
        history = taken.groupBy("lang", "h").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight"))
        suffix = F.substring("gram", 2, k - 1) if k > 1 else F.lit("")
        p = (
            taken.withColumn("s", suffix)
            .join(history, ["lang", "h"])
            .join(below.select("lang", F.col("gram").alias("s"), F.col("p").alias("lower")), ["lang", "s"])
            .select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * F.col("lower")).alias("p"))
        )
        #: Histories that end in a mark are n-grams of no probability of their own.
        weighed = below.join(history.withColumnRenamed("h", "gram"), ["lang", "gram"], "full").select(
            "lang", "gram", F.coalesce(F.log("p"), F.lit(0.0)).alias("p"), F.coalesce(F.log("weight"), F.lit(0.0)).alias("g")
        )
        out = weighed if out is None else out.union(weighed)
        below = cut(p, "order")
        made.append(below)
    out = cut(out.union(below.select("lang", "gram", F.log("p").alias("p"), F.lit(0.0).alias("g"))), "model")
    for df in (*counts.values(), *made):
        drop_cut(df)
    return out


def keyed(model: DataFrame) -> DataFrame:
    """(key, p, g) of a model: 63-bit keys in place of language and n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts = V.code_points(batch.column("gram"))
            n, seeds = np.diff(starts), _seeds(batch.column("lang"))
            key = np.zeros(len(n), V.U64)
            for k in range(ORDER + 1):
                own = n == k
                key[own] = keys(codes, starts[1:][own] - 1, k, seeds[own])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("p"), batch.column("g")], names=["key", "p", "g"])

    return model.mapInArrow(run, "key long, p double, g double")


class Lookup:
    """Sorted keys with a first place for each value of their upper bits."""

    def __init__(self, key: np.ndarray, p: np.ndarray, g: np.ndarray):
        order = np.argsort(key)
        self.key = np.append(key[order], -1)
        self.p, self.g = np.append(p[order], 0).astype(np.float32), np.append(g[order], 0).astype(np.float32)
        bits = max(1, int(len(key)).bit_length())
        self.shift = np.int64(63 - bits)
        top = np.append(key[order] >> self.shift, np.int64(1) << np.int64(bits))
        self.first = np.searchsorted(top, np.arange((1 << bits) + 1)).astype(np.int32)
        self.steps = int(np.diff(self.first).max(initial=1))

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, or that of the last row (0, 0)."""
        at = self.first[key >> self.shift]
        hit = self.key[at] == key
        out = np.where(hit, at, len(self.key) - 1)
        left = np.flatnonzero(~hit)
        for step in range(1, self.steps):
            if not len(left):
                break
            place = np.minimum(at[left] + step, len(self.key) - 1)
            now = self.key[place]
            hit = now == key[left]
            out[left[hit]] = place[hit]
            left = left[~hit & (now < key[left]) & (now >= 0)]
        return out


def _log_p(x: np.ndarray, at: np.ndarray, seed: np.ndarray, table_: Lookup) -> np.ndarray:
    """ln p of the symbol at each place: the longest n-gram there is, and the
    weights of the longer histories passed over on the way down to it."""
    total = np.zeros(len(at))
    todo, last = np.arange(len(at)), len(table_.key) - 1
    for k in range(ORDER, 0, -1):
        hit = table_.find(keys(x, at[todo], k, seed[todo]).view(np.int64))
        there = hit != last
        total[todo[there]] += table_.p[hit[there]]
        todo = todo[~there]
        if not len(todo):
            return total
        total[todo] += table_.g[table_.find(keys(x, at[todo] - 1, k - 1, seed[todo]).view(np.int64))]
    total[todo] += table_.p[table_.find(keys(x, at[todo], 0, seed[todo]).view(np.int64))]
    return total


def scored(df: DataFrame, model: DataFrame, text: str, lang: str, sent: int = SENT_ROWS) -> DataFrame:
    """All columns of ``df``, n__ (symbols) and nll__ (the sum of -ln p); of a
    language without a model nll__ is null."""
    if model.limit(sent + 1).count() > sent:
        return _scored_by_join(df, model, text, lang)
    langs = {r.lang for r in model.where("gram = ''").select("lang").collect()}
    t = keyed(model).toArrow()
    arrays = [t.column(c).to_numpy() for c in ("key", "p", "g")]
    table_ = df.sparkSession.sparkContext.broadcast((Lookup(*arrays), langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, langs = table_.value
        for batch in batches:
            for part in V.slices(batch, text, SCORED):
                yield _with_scores(part, text, lang, look, langs)

    return df.mapInArrow(run, widened(df, n__="long", nll__="double"))


def _block_keys(x: np.ndarray, begin: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Every key that scoring the texts may look up, once each."""
    n, at = np.diff(begin) - (ORDER - 1), _places(begin)
    seed = np.repeat(seeds, n)
    found = [np.unique(keys(x, at, k, seed)) for k in range(1, ORDER + 1)]
    found += [np.unique(keys(x, at - 1, k, seed)) for k in range(ORDER)]
    found.append(np.unique(keys(x[:1], np.zeros(len(seeds), np.int64), 0, seeds)) if len(x) else np.zeros(0, V.U64))
    return np.unique(np.concatenate(found)).view(np.int64)


def _scored_by_join(df: DataFrame, model: DataFrame, text: str, lang: str, block_bytes: int = BLOCK) -> DataFrame:
    """The same by joins. Each task cuts what it reads into blocks of text, written
    with the distinct n-grams of each block; these are joined with the shards of the
    model, and come back to their block, where the documents are scored. So the
    model is nowhere whole, a shuffle carries a block's n-grams once however often
    they are there, and a text moves once."""
    whole = T.StructType([T.StructField("block", T.StringType()), T.StructField("key", T.LongType()), T.StructField("row", df.schema)])
    arrow = to_arrow_schema(whole)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size, seen = TaskContext.get().partitionId(), 0, 0, np.zeros(0, np.int64)

        def grams() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(seen)), pa.array(seen), pa.nulls(len(seen), arrow.field("row").type)], schema=arrow)

        for batch in batches:
            for part in V.slices(batch, text, SCORED):
                name = f"{task}-{number}"
                x, begin = symbols(part.column(text))
                seen = np.union1d(seen, _block_keys(x, begin, _seeds(part.column(lang))))
                row = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(part.columns, arrow.field("row").type)], fields=list(arrow.field("row").type))
                yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows), pa.nulls(part.num_rows, pa.int64()), row], schema=arrow)
                size += part.column(text).nbytes
                if size >= block_bytes:
                    yield grams()
                    number, size, seen = number + 1, 0, np.zeros(0, np.int64)
        if len(seen):
            yield grams()

    written = cut(df.mapInArrow(blocks, whole), "blocks")
    found = written.where("key is not null").select("block", "key").join(keyed(model), "key").select("block", "key", "p", "g")
    lined = written.where("key is null").select("block", F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("g"), "row")
    both = found.withColumn("row", F.lit(None).cast(df.schema)).unionByName(lined)
    together = both.repartition("block").sortWithinPartitions("block", F.col("key").isNull())
    known = {r.lang for r in model.where("gram = ''").select("lang").collect()}  # a row a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, look = None, [], None
        for batch in batches:
            names = pc.dictionary_encode(batch.column("block"))
            of = names.indices.to_numpy()
            for a, b in zip(c := [0, *(np.flatnonzero(np.diff(of)) + 1).tolist()], [*c[1:], batch.num_rows]):
                piece = batch.slice(a, b - a)
                if (name := names.dictionary[int(of[a])].as_py()) != now:
                    now, held, look = name, [], None
                gram = pc.is_valid(piece.column("key"))
                if (n := pc.sum(gram).as_py() or 0):
                    held.append([piece.column(i).slice(0, n).to_numpy() for i in ("key", "p", "g")])
                if n < piece.num_rows:
                    if look is None:
                        look = Lookup(*map(np.concatenate, zip(*held))) if held else Lookup(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
                    rows = pa.RecordBatch.from_struct_array(piece.column("row").slice(n))
                    for part in V.slices(rows, text, SCORED):
                        yield _with_scores(part, text, lang, look, known)

    return together.mapInArrow(run, widened(df, n__="long", nll__="double"))


def _with_scores(part: pa.RecordBatch, text: str, lang: str, look: Lookup, langs: set[str]) -> pa.RecordBatch:
    x, begin = symbols(part.column(text))
    n = np.diff(begin) - (ORDER - 1)
    log_p = _log_p(x, _places(begin), np.repeat(_seeds(part.column(lang)), n), look)
    sums = np.concatenate([[0], np.cumsum(log_p)])
    ends = np.concatenate([[0], np.cumsum(n)])
    nll = np.round(-(sums[ends[1:]] - sums[ends[:-1]]), 3)
    known = pc.is_in(pc.fill_null(part.column(lang), ""), value_set=pa.array(sorted(langs), pa.string())).to_numpy(zero_copy_only=False)
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(n), pa.array(nll, mask=~known)], names=[*part.schema.names, "n__", "nll__"])


def limits(held: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> dict[str, tuple[float, float]]:
    """Of each language of the scored trusted rows (lang, n__, nll__): the mean of
    -ln p of a symbol, and the greatest allowed. One row a language comes back."""
    rows = held.where("n__ > 0 and nll__ is not null").withColumn("lang", F.coalesce("lang", F.lit("")))
    means = {r.lang: r.m for r in rows.groupBy("lang").agg((F.sum("nll__") / F.sum("n__")).alias("m")).collect()}
    shrunk = rows.withColumn("s", _shrunk(F.col("lang"), means))
    top = shrunk.groupBy("lang").agg(F.percentile_approx("s", quantile, 100_000).alias("q")).collect()
    return {r.lang: (means[r.lang], r.q + float(np.log(margin))) for r in top}


def _shrunk(lang: Column, means: dict[str, float]) -> Column:
    if not means:
        return F.lit(None).cast("double")
    mean = F.create_map(*[F.lit(x) for k, v in means.items() for x in (k, float(v))])
    return (F.col("nll__") + PRIOR * F.try_element_at(mean, F.coalesce(lang, F.lit("")))) / (F.col("n__") + PRIOR)


def _fitted(docs: DataFrame, labels: DataFrame, sent: int) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    trusted = with_trust(docs, labels).where("trusted").withColumn("text", F.col("text").cast("string"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0
    model = train(trusted.where(~held).select("lang", "text"))
    return model, limits(scored(trusted.where(held).select("lang", "text"), model, "text", "lang", sent))


def judged(df: DataFrame, docs: DataFrame, labels: DataFrame, text: str, lang: str, sent: int = SENT_ROWS) -> DataFrame:
    """All columns of ``df``, perplexity__ (null of a text without symbols or a
    language without a model), compared__ (the same with PRIOR more symbols of the
    language's mean), limit__ (the greatest that stays, of the language) and keep__;
    see ``keep``."""
    model, most = _fitted(docs, labels, sent)
    out = scored(df, model, text, lang, sent)
    s = F.round(_shrunk(F.col(lang), {k: m for k, (m, _) in most.items()}), 6)
    limit = F.lit(None).cast("double")
    if most:
        limit = F.try_element_at(
            F.create_map(*[F.lit(x) for k, (_, q) in most.items() for x in (k, round(float(q), 6))]), F.coalesce(F.col(lang), F.lit(""))
        )
    ok = (F.col("n__") > 0) & ~F.coalesce(s > limit, F.lit(False))
    value = lambda c: F.when(F.col("n__") > 0, F.round(F.exp(c), 3))
    return out.withColumns({"keep__": ok, "perplexity__": value(F.col("nll__") / F.col("n__")), "compared__": value(s), "limit__": value(limit)}).drop("n__", "nll__")


def keep(docs: DataFrame, labels: DataFrame, sent: int = SENT_ROWS) -> DataFrame:
    """The documents that aren't rejected, with all their columns.

    A text without symbols (null, empty, blank) is rejected. A document of a language
    without trusted text can't be judged and stays; a null language is one of its
    own. Equal texts of a language are judged alike and repeated rows stay or go
    together; ties with the limit stay. A text of any length counts whole."""
    p = Positional(docs)
    text, lang = p.at("text"), p.at("lang")
    df = p.df.withColumn(text, F.col(text).cast("string")).withColumn(lang, F.col(lang).cast("string"))
    return p.restore(judged(df, docs, labels, text, lang, sent).where("keep__"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that aren't rejected, with their perplexity, the number that was
    compared, and the limit of their language."""
    docs = table(spark, sf_dir, "documents")
    rows = pick(docs, "doc_id", "lang", "text")
    out = judged(rows, docs, table(spark, sf_dir, "labels"), "text", "lang").where("keep__")
    return out.select("doc_id", "lang", *[F.col(f"{c}__").alias(c) for c in ("perplexity", "compared", "limit")])
