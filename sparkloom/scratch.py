"""Tables written to the folder that all executors share, and read again: what is reused isn't kept on executors."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``; it is deleted when the driver ends.
    Where that is unset, a session on one machine has a folder below the warehouse;
    on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, f"{at.rstrip('/')}/sparkloom-{what}-{uuid.uuid4().hex}"))
    return _made[-1][1]


def written(df: DataFrame, what: str) -> DataFrame:
    at = folder(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _sweep() -> None:
    for spark, at in _made:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may have ended before
            return
