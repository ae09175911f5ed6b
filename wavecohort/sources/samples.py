"""Stored samples whose order the planner knows.

Samples lie in buckets of (keys, time slice). A slice is a range of times, so later batches fall into
the slices they belong to, and a long recording spreads over many buckets. Reading gives
``_chunk`` (the slice) and ``_pos`` (the place in it), which is what ordered work starts from; the
scan is bucketed, so neither needs a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from wavecohort.operators.ordered import CHUNK, POS

#: Ten minutes: 60,000 rows at 100 a second.
SLICE_NS = 600 * 10**9
BUCKETS = 64


@dataclass(frozen=True)
class SampleTable:
    """A folder of samples with the columns of ``schema``; keys, buckets and slice are kept for life.

    A task holds the slices of a bucket, one at a time: rate times ``slice_ns`` rows, more only
    where a sensor repeats its times.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: Sequence[str] = ("session_id",)
    ts: str = "timestamp_ns"
    buckets: int = BUCKETS
    slice_ns: int = SLICE_NS

    @property
    def name(self) -> str:
        """Its name in the session's catalog, which is where Spark looks up buckets."""
        return f"samples_{hashlib.md5(self.path.encode()).hexdigest()}"

    def _slice(self) -> Column:
        """Samples without a time come first, as they do in order."""
        return F.coalesce(F.floor(F.col(self.ts) / F.lit(self.slice_ns)).cast("bigint"), F.lit(-(1 << 62)))

    def _open(self) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        by = ", ".join(f"`{c}`" for c in (*self.keys, CHUNK))
        location = self.path.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, `{CHUNK}` bigint) USING parquet"
            f" CLUSTERED BY ({by}) SORTED BY ({by}, `{self.ts}`) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )

    def append(self, rows: DataFrame) -> None:
        """Add samples; at most one file for each bucket that they touch."""
        self._open()
        by = [*self.keys, CHUNK]
        placed = rows.select(*self.schema.names, self._slice().alias(CHUNK))
        placed = placed.repartition(self.buckets, *by)
        placed.write.bucketBy(self.buckets, *by).sortBy(*by, self.ts).mode("append").format("parquet").option(
            "path", self.path
        ).saveAsTable(self.name)

    def read(self) -> DataFrame:
        """All samples with ``_chunk`` and ``_pos``; rows of one time are told apart by a hash of the row."""
        self._open()
        order = Window.partitionBy(*self.keys, CHUNK).orderBy(self.ts, F.xxhash64(*self.schema.names))
        return self.spark.table(self.name).withColumn(POS, (F.row_number().over(order) - 1).cast("bigint"))

    def forget(self) -> None:
        """Take the name out of the session's catalog; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
