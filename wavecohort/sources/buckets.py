"""Tables in buckets of a key, of which a merge rewrites only those that a batch touches.

A table is a folder of generations, ``gen=<number>/bucket=<number>``. A generation holds the whole new content of
the buckets it touched and counts once its success marker is there; a bucket's content is that of the newest
complete generation that has it. Writing a generation again replaces it. What newer generations replaced is
deleted by ``prune``, some generations later, so that running readers finish.

A log is a folder of batches, ``log/batch=<number>``; folding merges it into the table beside it and then
deletes the folded batches, so that reading never scans more than was not folded yet.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from wavecohort.session import durable

BUCKET = "bucket"
BUCKETS = 64

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def bucket_of(key: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _listed(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders ``<kind>=<number>`` right below a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [e.getPath().getName() for e in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(m[1]) for m in (re.fullmatch(rf"{kind}=(\d+)", n) for n in names) if m)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def generations(spark: SparkSession, root: str) -> list[int]:
    """Complete generations, oldest first."""
    return [g for g in _listed(spark, root, "gen") if _exists(spark, f"{root}/gen={g:08d}/_SUCCESS")]


def newest(spark: SparkSession, root: str, below: int | None = None) -> dict[int, int]:
    """The generation that holds each bucket's content, of all or of those before ``below``."""
    found: dict[int, int] = {}
    for g in generations(spark, root):
        if below is None or g < below:
            found |= dict.fromkeys(_listed(spark, f"{root}/gen={g:08d}", BUCKET), g)
    return found


def read_buckets(spark: SparkSession, root: str, schema: StructType, only: Sequence[int] | None = None, below: int | None = None) -> DataFrame:
    """The table, or some of its buckets; a table never written is empty."""
    held = newest(spark, root, below)
    paths = [f"{root}/gen={g:08d}/{BUCKET}={b}" for b, g in sorted(held.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_buckets(batch: DataFrame, root: str, schema: StructType, key: Sequence[str], merge: Merge, number: int | None = None, buckets: int = BUCKETS) -> int:
    """Merge ``batch`` into the buckets its keys fall into and return the generation.

    ``merge(stored, batch)`` gives the new rows of these buckets; it has to be idempotent. A generation written
    again starts from the ones before it. The driver sees the numbers of the touched buckets. A table keeps its
    number of buckets for life.
    """
    spark = batch.sparkSession
    done = generations(spark, root)
    number = (done[-1] + 1 if done else 1) if number is None else number
    touched = [r[0] for r in batch.select(bucket_of(key, buckets).alias(BUCKET)).distinct().collect()]
    merged = merge(read_buckets(spark, root, schema, touched, number), batch)
    # Rebalancing splits a large bucket over tasks and joins small ones.
    placed = merged.withColumn(BUCKET, bucket_of(key, buckets)).hint("rebalance", BUCKET)
    placed.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{root}/gen={number:08d}")
    return number


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete buckets that were replaced, but for those replaced in the last ``keep`` generations."""
    done = generations(spark, root)
    if len(done) <= keep:
        return
    held = newest(spark, root, done[-keep])
    for g in done[:-keep]:
        there = _listed(spark, f"{root}/gen={g:08d}", BUCKET)
        old = [b for b in there if held[b] != g]
        if len(old) == len(there):
            _delete(spark, f"{root}/gen={g:08d}")
        else:
            for b in old:
                _delete(spark, f"{root}/gen={g:08d}/{BUCKET}={b}")


# ---- a log beside the table

def log_batch(batch: DataFrame, root: str, number: int) -> None:
    """Append a batch to the log; the same number written again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{root}/log/batch={number}")


def folded_until(spark: SparkSession, root: str) -> int:
    """The highest batch that the table holds: generation n + 1 holds all up to batch n."""
    done = generations(spark, f"{root}/table")
    return done[-1] - 1 if done else -1


def unfolded(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The rows of the batches that are not folded yet, with their ``batch``; others are not opened."""
    until = folded_until(spark, root)
    numbers = [n for n in _listed(spark, f"{root}/log", "batch") if n > until]
    if not numbers:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("bigint"))
    full = StructType(schema.fields).add("batch", "long")
    return spark.read.schema(full).option("basePath", f"{root}/log").parquet(*[f"{root}/log/batch={n}" for n in numbers])


def fold(spark: SparkSession, root: str, schema: StructType, logged: StructType, key: Sequence[str], merge: Merge, buckets: int = BUCKETS) -> int | None:
    """Merge the batches that are not folded yet into the table and delete all folded ones; the generation, if any."""
    numbers = _listed(spark, f"{root}/log", "batch")
    number = None
    if numbers and numbers[-1] > folded_until(spark, root):
        rows = durable(unfolded(spark, root, logged), "unfolded")
        number = merge_buckets(rows, f"{root}/table", schema, key, merge, numbers[-1] + 1, buckets)
        prune(spark, f"{root}/table")
    for n in _listed(spark, f"{root}/log", "batch"):
        if n <= folded_until(spark, root):
            _delete(spark, f"{root}/log/batch={n}")
    return number
