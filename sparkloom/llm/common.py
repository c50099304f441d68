"""Helpers shared by the operators: columns by position, scratch tables, row keys."""

from __future__ import annotations

import atexit
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Positional:
    """A table whose columns are renamed by position, so that no name a caller
    uses can clash with an operator's own; ``restore`` gives the names back."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.inner = [f"c{i}__" for i in range(len(self.names))]
        self.df = df.toDF(*self.inner)

    def at(self, name: str) -> str:
        """Inner name of a column: the exact name first, else any case."""
        if name in self.names:
            return self.inner[self.names.index(name)]
        for i, n in enumerate(self.names):
            if n.lower() == name.lower():
                return self.inner[i]
        raise ValueError(f"no column {name!r} among {self.names}")

    def restore(self, df: DataFrame) -> DataFrame:
        return df.select(*self.inner).toDF(*self.names)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds."""
    p = Positional(df)
    return p.df.select(*[F.col(p.at(n)).alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where that is
    unset, a session on one machine has a folder below the warehouse; on a cluster
    it is an error, as executors would write to disks of their own."""
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return at.rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends
    there, and the loss of an executor costs nothing that was done before.
    The written files go when the Python driver ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/sparkloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, at))
    return spark.read.schema(df.schema).parquet(at)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote, once nothing reads it."""
    files = df.inputFiles()
    for item in list(_made):
        if files and f"/{item[1].rsplit('/', 1)[1]}/" in files[0]:
            _delete(*item)
            _made.remove(item)


def _delete(spark: SparkSession, at: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _sweep() -> None:
    for spark, at in _made:
        try:
            _delete(spark, at)
        except Exception:  # the session may have ended before
            return


def widened(df: DataFrame, **more: str) -> T.StructType:
    """The schema of ``df`` with more columns (name=type), whatever its names and types."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.DataType.fromDDL(t)) for n, t in more.items())])


def row_keys(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes over all columns; nulls count as values of their own.
    Rows that agree in both are copies of one row."""
    flags = reduce(
        lambda a, b: F.concat(a, b), [F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns]
    )
    return [F.xxhash64(flags, *columns), F.xxhash64(F.lit(77), *reversed(columns), flags)]


def prefix_sums(
    df: DataFrame, by: list[str], bucket: str, order: list[Column], amount: str, out: str
) -> DataFrame:
    """Exclusive running sum of ``amount`` in each group of ``by``, over buckets
    in order and inside them by ``order``. Two levels, so that no task needs more
    than one bucket of one group, or one group's list of buckets."""
    from pyspark.sql import Window as W

    per = df.groupBy(*by, bucket).agg(F.sum(amount).alias("in_bucket__"))
    over = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    start = per.select(*by, bucket, F.coalesce(F.sum("in_bucket__").over(over), F.lit(0)).alias("start__"))
    inner = W.partitionBy(*by, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.withColumn("inner__", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
        .join(start, [*by, bucket])
        .withColumn(out, F.col("start__") + F.col("inner__"))
        .drop("start__", "inner__")
    )
