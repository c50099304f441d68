"""Tables of documents: Parquet, by bucket and shard of the id; upserts, deletes, scans, export.

A table is a folder of files by bucket, shard and write, and small files
``_CURRENT.<n>`` that say which of them are version n. A write only makes anew the
(bucket, shard) parts it touches, then puts its ``_CURRENT.<n>`` in place by a rename.
Readers take the greatest n, so they never see half of a write, a write that dies
at any moment leaves the table as it was, and of two writers at once the second
fails. Files of the last version but one stay for readers that began before.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass
from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..operators import predicates as P
from ..scratch import written
from . import transform

if TYPE_CHECKING:
    from ..operators.fulltext import SearchIndex

PARTITION = "index_bucket"
#: About how many documents a task writes, and how many ids it compares: the size of a
#: document as Parquet says little of its size in memory.
ROWS, IDS = 100_000, 1_000_000
#: So many ids, counted, are sent to all tasks; more are shuffled.
FEW_IDS = 100_000


class IndexStats(NamedTuple):
    indexed: int
    failed: int


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities of JSON lines at any path Spark can read. Context may be one value
    or a list. Lines that aren't JSON, or have no id, come as rows without an id,
    which a table counts as failed; blank lines don't come."""
    context = {f.name for f in transform.ENTITY.fields} - {"id", "schema", "properties"}
    row = spark.read.text(path).select(F.col("value").alias("line"), F.get_json_object("value", "$.id").alias("id")).where("trim(line) <> ''")
    row = row.select(
        "id", F.get_json_object("line", "$.schema").alias("schema"),
        F.from_json(F.get_json_object("line", "$.properties"), transform.VALUES).alias("properties"),
        *[F.get_json_object("line", f"$.{c}").alias(c) for c in sorted(context)],
    )
    as_list = lambda c: F.when(F.col(c).startswith("["), F.from_json(c, "array<string>")).when(F.col(c).isNotNull(), F.array(F.col(c)))
    return row.select("id", "schema", "properties", *[as_list(c).alias(c) for c in sorted(context)])


def read_actions(spark: SparkSession, path: str, schema) -> DataFrame:
    """Documents that ``export_actions`` wrote."""
    actions = spark.read.text(path)
    return actions.select(F.from_json(F.get_json_object("value", "$._source"), schema).alias("s")).select("s.*")


def latest(rows: DataFrame, key: str = "_id", order: str = "seq") -> DataFrame:
    """Of rows with the same key the one of the greatest ``order``."""
    first = W.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("k__", F.row_number().over(first)).where("k__ = 1").drop("k__")


def _few(ids: DataFrame, n: int) -> DataFrame:
    """The smaller side of a join: its estimated size says nothing, as it is that of
    documents cut down to their ids."""
    return F.broadcast(ids) if n <= FEW_IDS else ids.hint("shuffle_hash")


def _last(rows: DataFrame, n: int) -> DataFrame:
    """Of ``n`` documents those that are the last of their id, by ``at__``. Only ids are
    shuffled, unless many are repeated."""
    ids = rows.select("_id", "at__").repartition(n // IDS + 1, "_id")
    again = written(ids.groupBy("_id").agg(F.count("*").alias("n__"), F.max("at__").alias("last__")).where("n__ > 1").select("_id", "last__"), "again")
    if repeated := again.count():
        rows = rows.join(_few(again, repeated), "_id", "left").where("last__ is null or at__ = last__").drop("last__")
    return rows


def shard_of(_id: str, shards: int) -> int:
    return zlib.crc32(_id.encode()) % shards


@dataclass
class EntityStore:
    """``shards`` is how many parts a bucket has; it is fixed when the table is made,
    and should grow with what it is to hold."""

    spark: SparkSession
    path: str
    shards: int = 16

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.path))]
        return sorted(int(n[9:]) for n in names if n.startswith("_CURRENT.") and n[9:].isdigit())

    def _state(self, n: int) -> dict:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/_CURRENT.{n}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _current(self) -> dict:
        known = self._numbers()
        return self._state(known[-1]) if known else {"version": 0, "shards": self.shards, "parts": {}}

    def version(self) -> int:
        """0 if the table isn't there, else a number that each write raises."""
        return max(self._numbers(), default=0)

    @staticmethod
    def _part(bucket: str, shard: int) -> str:
        return f"{PARTITION}={bucket}/shard={shard}"

    def _publish(self, df: DataFrame, was: dict, touched: set[str] | None, rows: int = 0) -> None:
        """Writes ``df`` of about so many rows as the whole of the touched parts (None: of
        all) and makes this the next version."""
        n, write, shards = was["version"] + 1, f"{was['version'] + 1}-{uuid.uuid4().hex[:12]}", was["shards"]
        placed = df.withColumns({"shard": (F.crc32(F.col("_id").cast("binary")) % shards).cast("int"), "write": F.lit(write)})
        slices = 2 * rows // (ROWS * max(1, len(model.BUCKETS) * shards if touched is None else len(touched))) + 1
        placed = placed.repartition(rows // ROWS + 1, PARTITION, "shard", F.pmod(F.xxhash64("_id"), F.lit(slices)))
        placed.write.mode("append").partitionBy(PARTITION, "shard", "write").parquet(f"{self.path}/data")
        fs, path = self._fs()
        parts = {} if touched is None else {k: v for k, v in was["parts"].items() if k not in touched}
        names = touched if touched is not None else {self._part(b, i) for b in model.BUCKETS for i in range(shards)}
        parts |= {k: write for k in names if fs.exists(path(f"{self.path}/data/{k}/write={write}"))}
        schema = T.StructType([f for f in df.schema.fields if f.name not in ("shard", "write")])
        fresh = path(f"{self.path}/.current-{write}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps({"version": n, "shards": shards, "schema": schema.jsonValue(), "parts": parts}).encode()))
        out.close()
        self._place(fresh, n)
        self._forget(n)

    def _place(self, fresh, n: int) -> None:
        fs, path = self._fs()
        if fs.exists(path(f"{self.path}/_CURRENT.{n}")) or not fs.rename(fresh, path(f"{self.path}/_CURRENT.{n}")):
            fs.delete(fresh, False)
            raise RuntimeError(f"another write made version {n} of {self.path}")

    def _forget(self, n: int) -> None:
        """Deletes what only versions before the last but one had."""
        fs, path = self._fs()
        kept = {(k, w) for i in (n, n - 1) if i in self._numbers() for k, w in self._state(i)["parts"].items()}
        for i in self._numbers():
            if i < n - 1:
                for k, w in self._state(i)["parts"].items():
                    if (k, w) not in kept:
                        fs.delete(path(f"{self.path}/data/{k}/write={w}"), True)
                fs.delete(path(f"{self.path}/_CURRENT.{i}"), False)
                fs.delete(path(f"{self.path}/_text/v{i}"), True)

    def _read(self, now: dict, buckets: list[str] | None = None, shards: set[int] | None = None) -> DataFrame:
        if not now["version"]:
            raise ValueError(f"no table at {self.path}")
        schema = T.StructType.fromJson(now["schema"])
        names = [self._part(b, i) for b in (buckets or model.BUCKETS) for i in (range(now["shards"]) if shards is None else sorted(shards))]
        paths = [f"{self.path}/data/{k}/write={now['parts'][k]}" for k in names if k in now["parts"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).select(*schema.names)

    def read(self, schemata: list[str] | None = None) -> DataFrame:
        """The table; only the files of the given classes' buckets, and those below."""
        return self._read(self._current(), model.buckets_of(schemata) if schemata else None)

    def create(self, like: DataFrame) -> None:
        """An empty table. If there is one already, columns that are new are added (to
        the schema only: rows that were written before have nulls); a column of
        another type is an error."""
        was = self._current()
        if not was["version"]:
            return self._publish(like.limit(0).withColumn("seq", F.lit(0).cast("bigint")), was, None)
        now = dict(self.read().dtypes)
        for name, kind in like.dtypes:
            if name in now and now[name] != kind and name != PARTITION:
                raise ValueError(f"column {name} is {now[name]}, not {kind}")
        added = [F.lit(None).cast(k).alias(n) for n, k in like.dtypes if n not in now]
        if added:
            self._publish(self.read().limit(0).select("*", *added), was, set())

    def upsert(self, docs: DataFrame) -> IndexStats:
        """Documents replace those of their id, in whatever bucket these are. Rows of
        a null id, or of no bucket, are counted as failed. Of rows that repeat an id
        the last counts, in the order they are read. Only the parts that hold an old
        or a new document of these ids are written."""
        was = self._current()
        ok = F.col("_id").isNotNull() & F.col(PARTITION).isNotNull()
        rows = written(docs.withColumns({"ok__": ok, "at__": F.monotonically_increasing_id()}), "upsert")
        counts = rows.agg(F.count_if("ok__").alias("ok"), F.count_if(~F.col("ok__")).alias("bad")).first()
        shard = (F.crc32(F.col("_id").cast("binary")) % was["shards"]).cast("int").alias("shard")
        new = _last(rows.where("ok__"), counts.ok).drop("ok__", "at__").withColumn("seq", F.lit(was["version"] + 1).cast("bigint"))
        touched = {self._part(r[0], r.shard) for r in new.select(PARTITION, shard).distinct().collect()}  # at most buckets x shards
        there = 0
        if was["version"]:
            near = {int(k.rpartition("=")[2]) for k in touched}
            old = self._read(was, shards=near)
            there = old.count()
            tasks = (there + counts.ok) // IDS + 1
            ids = new.select("_id").repartition(tasks, "_id").hint("shuffle_hash")
            gone = written(old.select("_id", PARTITION).repartition(tasks, "_id").join(ids, "_id", "left_semi"), "gone")
            parts = gone.groupBy(PARTITION, shard).agg(F.count("*").alias("n")).collect()  # at most buckets x shards
            touched |= {self._part(r[0], r.shard) for r in parts}
            kept = old.where(F.concat(F.lit(f"{PARTITION}="), PARTITION, F.lit("/shard="), shard).isin(sorted(touched)))
            if replaced := sum(r.n for r in parts):
                kept = kept.join(_few(gone.select("_id"), replaced), "_id", "left_anti")
            new = kept.unionByName(new, allowMissingColumns=True)
        self._publish(new, was, touched, there + counts.ok)
        return IndexStats(counts.ok, counts.bad)

    def index(self, dataset: str, entities: DataFrame, **more) -> IndexStats:
        """Entities become documents of a dataset. Rows without an id (bad lines) count
        as failed; entities of abstract classes are passed over."""
        done = self.upsert(transform.documents(entities, dataset, **more))
        return IndexStats(done.indexed, done.failed + entities.where("id is null").count())

    def put(self, entity: dict, dataset: str) -> IndexStats:
        """One entity (id, schema, properties)."""
        return self.index(dataset, self.spark.createDataFrame([entity], T.StructType([f for f in transform.ENTITY.fields if f.name in entity])))

    def delete(self, where: Column) -> int:
        """Documents for which ``where`` is true go; how many were there. Only the
        parts that hold any of them are written."""
        was = self._current()
        shard = (F.crc32(F.col("_id").cast("binary")) % was["shards"]).cast("int").alias("shard")
        gone = self.read().where(where).groupBy(PARTITION, shard).agg(F.count("*").alias("n")).collect()
        if gone:
            touched = {self._part(r[0], r.shard) for r in gone}
            left = self._read(was, sorted({r[0] for r in gone}), {r.shard for r in gone})
            left = left.where(F.concat(F.lit(f"{PARTITION}="), PARTITION, F.lit("/shard="), shard).isin(sorted(touched)))
            self._publish(left.where(~F.coalesce(where, F.lit(False))), was, touched, left.count())
        return sum(r.n for r in gone)

    def delete_ids(self, ids: list[str]) -> int:
        return self.delete(F.col("_id").isin(ids))

    def clear(self) -> None:
        self._publish(self.read().limit(0), self._current(), None)

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)

    def search_index(self, buckets: int = 64) -> SearchIndex:
        """The text index of this version, analysed when it is first asked for."""
        from ..operators.fulltext import load_index, save_index

        n, docs = self.version(), self.read()
        at = f"{self.path}/_text/v{n}"
        fs, path = self._fs()
        if not fs.exists(path(f"{at}/stats/_SUCCESS")):
            save_index(docs, at, buckets=buckets)
        return load_index(self.spark, at, docs)

    def scan(
        self, auth: model.Auth | None = None, dataset: str | None = None, collection_id: int | None = None, schemata: list[str] | None = None,
        filters: dict[str, list] | None = None, columns: list[str] | None = None, sort: str | None = None,
    ) -> DataFrame:
        """Documents that pass all filters; a collection wins over a dataset."""
        df = self.read(schemata)
        tests = [P.field_terms(df, f, v) for f, v in (filters or {}).items()]
        if auth is not None:
            tests.append(P.acl(auth))
        if collection_id is not None:
            tests.append(F.col("collection_id") == str(collection_id))
        elif dataset is not None:
            tests.append(F.col("dataset") == dataset)
        if schemata:
            tests.append(P.schemata(schemata, True))
        for t in tests:
            df = df.where(t)
        if sort:
            name, _, way = sort.partition(":")
            df = df.orderBy(F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_last(), "_id")
        return df.select(*columns) if columns else df

    def by_ids(self, ids: list[str] | DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Documents of these ids, from their shards; of a table with ``_id``, by a join."""
        now = self._current()
        if isinstance(ids, DataFrame):
            wanted = written(ids.select("_id").distinct(), "ids")
            df = self._read(now).join(_few(wanted, wanted.count()), "_id", "left_semi")
        else:
            df = self._read(now, shards={shard_of(i, now["shards"]) for i in ids}).where(F.col("_id").isin(ids))
        return df.select(*columns) if columns else df

    def adjacent(self, entity_id: str, dataset: str | None = None) -> DataFrame:
        """Documents one of whose entities is this one."""
        df = self.read().where(F.array_contains("entities", entity_id))
        return df.where(F.col("dataset") == dataset) if dataset else df

    def content_of(self, entity_id: str) -> str | None:
        """Whole text of a document; None if there is none or it isn't a document."""
        row = self.by_ids([entity_id]).where(F.col("schema").isin(list(model.schema("Document").descendants)))
        got = row.select(fulltext().alias("t")).first()
        return got.t if got else None

    def version_of(self, entity_id: str) -> tuple[int, int] | None:
        row = self.by_ids([entity_id], ["seq"]).first()
        return (row.seq, 1) if row else None

    def export_actions(self, path: str, where: Column | None = None, hidden_columns: bool = False, records: int = 0) -> None:
        """Documents as JSON lines of ``_id``, ``_index`` and ``_source``, in files of at
        most so many (0: of any number)."""
        df = self.read()
        if where is not None:
            df = df.where(where)
        source = [c for c in df.columns if hidden_columns or c not in transform.HIDDEN_COLUMNS]
        df.select("_id", F.concat(F.lit("entity-"), F.col(PARTITION)).alias("_index"), F.struct(*source).alias("_source")).write.mode("overwrite").option("maxRecordsPerFile", records).json(path)

    def entities(self, where: Column | None = None) -> DataFrame:
        """(id, schema, properties, datasets, origin, tags, referents) of stored documents,
        as entities that can be read again."""
        df = self.read() if where is None else self.read().where(where)
        return df.select(F.col("_id").alias("id"), "schema", "properties", F.array("dataset").alias("datasets"), "origin", "tags", "referents")

    def write_entities(self, path: str, records: int = 10_000, where: Column | None = None) -> None:
        """The same as JSON lines, in files of at most so many entities."""
        self.entities(where).write.mode("overwrite").option("maxRecordsPerFile", records).json(path)

    def get_json(self, entity_id: str) -> dict | None:
        row = self.by_ids([entity_id]).select(F.to_json(F.struct("*")).alias("j")).first()
        return json.loads(row.j) if row else None


def fulltext() -> Column:
    """Text of a document: its body, else what was indexed of it, in lines."""
    body = transform.values("bodyText")
    joined = F.array_join(F.when(F.size(body) > 0, body).otherwise(F.col("content")), "\n")
    return F.when(joined != "", joined)


def checksum_counts(docs: DataFrame, checksums: DataFrame) -> DataFrame:
    """(checksum, n): how many documents have each checksum, 0 too."""
    found = docs.select("_id", F.explode(F.array_distinct("checksums")).alias("checksum"))
    wanted = checksums.select("checksum").distinct()
    return wanted.join(found, "checksum", "left").groupBy("checksum").agg(F.count("_id").alias("n"))


def cross_bucket_duplicates(docs: DataFrame, keep: str = "pages", drop: str = "documents") -> DataFrame:
    """Ids that are in both buckets, once each."""
    inside = docs.where(F.col(PARTITION) == drop).select("_id").distinct()
    return inside.join(docs.where(F.col(PARTITION) == keep).select("_id"), "_id", "left_semi")


def without_cross_bucket_duplicates(docs: DataFrame, keep: str = "pages", drop: str = "documents") -> DataFrame:
    """All documents but those of ``drop`` whose id is in ``keep`` too."""
    kept = docs.where(F.col(PARTITION) == keep).select("_id").distinct().withColumn("k__", F.lit(True))
    joined = docs.join(kept, "_id", "left")
    return joined.where((F.col(PARTITION) != drop) | F.col("k__").isNull()).drop("k__")


def adjacency(docs: DataFrame) -> DataFrame:
    """(entity_id, _id) of every document and every entity it names."""
    return docs.select(F.explode(F.array_distinct("entities")).alias("entity_id"), "_id")
