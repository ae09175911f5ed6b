"""Structured Streaming forms of the merge, quality, run, pairing with stored recordings and file checks.

Each takes a streaming DataFrame. Aggregations run with watermarks and bounded state;
merges run per micro-batch and are idempotent, so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wavecohort.functions import clock
from wavecohort.functions.values import finite
from wavecohort.operators.intervals import PAIR_WINDOW_S, nearest_interval
from wavecohort.plans.ingest import log_readings
from wavecohort.session import durable, prepare
from wavecohort.sources.bundles import check_files


#: Take what is there and stop; ``{"processingTime": "1 minute"}`` goes on.
ONCE = {"availableNow": True}


def each_batch(
    stream: DataFrame,
    checkpoint: str,
    work: Callable[[DataFrame, int], None],
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run ``work`` on every micro-batch, with the settings of ``prepare``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        prepare(batch.sparkSession)
        work(batch, batch_id)

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .foreachBatch(run)
        .start()
    )


def upsert_readings(stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Continuous first-writer merge with late back-fill of blank provenance columns.

    A micro-batch is only appended to the log below ``root``, so its cost does not grow
    with the table; ``merged_readings`` applies the merge when the table is read.
    """
    return each_batch(stream, checkpoint, lambda batch, batch_id: log_readings(batch, root, batch_id), trigger=trigger)


def hourly_quality(stream: DataFrame, late: str = "2 hours", keys: tuple[str, ...] = ()) -> DataFrame:
    """Hourly means; rows later than ``late`` are dropped and an hour is final after that.

    Hours that the watermark has not passed when the stream ends are not given yet.
    """
    timed = stream.withColumn("at", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("bigint")))
    hours = timed.withWatermark("at", late).groupBy(F.window("at", "1 hour"), *keys).agg(
        F.avg("sqi").alias("sqi"),
        F.avg("hr_ppg").alias("hr"),
        F.count("*").alias("minutes"),
        F.avg("acc_motion").alias("motion"),
    )
    return hours.select(
        clock.epoch_s(F.col("window.start")).alias("bucket"),
        *keys,
        *[finite(F.col(c)).alias(c) for c in ("sqi", "hr", "motion")],
        "minutes",
    )


def recording_runs(stream: DataFrame, keys: tuple[str, ...], gap_s: int, late: str = "2 hours") -> DataFrame:
    """Runs of rows without a step above ``gap_s``; a run is final once the watermark passed it.

    Runs still open when the stream ends are not given yet.
    """
    timed = stream.withColumn("at", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("bigint")))
    # A session window ends where the next row comes at or after the gap; one microsecond more
    # keeps a step of exactly the gap inside the run.
    gap = f"{gap_s} seconds 1 microsecond"
    runs = timed.withWatermark("at", late).groupBy(F.session_window("at", gap), *keys).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("points")
    )
    return runs.drop("session_window")


def aged(latest: DataFrame, now: float, stale_s: float) -> DataFrame:
    """Ages of the last activities at a time of asking, also between batches."""
    age = clock.age_s(F.col("last_ts"), now)
    return latest.withColumn("age_s", age).withColumn("stale", age > stale_s)


PAIR_DDL = "reading_id string, subject_id string, t double, session_id bigint, gap double"
WAIT_DDL = "reading_id string, subject_id string, t double"


def pair_readings(
    stream: DataFrame,
    intervals: Callable[[SparkSession], DataFrame],
    root: str,
    checkpoint: str,
    tolerance: float = PAIR_WINDOW_S,
    wait_s: float | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Match arriving readings to recordings; unmatched ones wait for the recording to arrive.

    ``stream`` has reading_id, subject_id and t. Each batch works on its own rows and on
    those still waiting after the batch before, and writes to folders of its own number, so
    a replay overwrites itself and pairs found earlier are not rewritten. With ``wait_s`` a
    reading that is older than the newest one by more than that stops waiting and is written below
    ``unmatched``, so that the waiting set stays bounded; only recordings that can still match are swept.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("reading_id", "subject_id", "t")
        if batch_id > 0:
            rows = rows.unionByName(spark.read.schema(WAIT_DDL).parquet(f"{root}/waiting/batch={batch_id - 1}"))
        todo = durable(rows.groupBy("reading_id").agg(F.min_by(F.struct("subject_id", "t"), "t").alias("r")).select("reading_id", "r.*"), "todo")
        spans = intervals(spark)
        first, last = todo.agg(F.min("t"), F.max("t")).first()
        if first is not None:
            end = F.coalesce("end_time", "start_time")
            spans = spans.where((end >= first - tolerance) & (F.col("start_time") <= last + tolerance))
        near = durable(
            nearest_interval(
                todo, spans, "subject_id", "t", "start_time", "end_time", "id", "gap", "session_id"
            ),
            "near",
        )
        hit = F.coalesce(F.col("gap") <= tolerance, F.lit(False))
        near.where(hit).write.mode("overwrite").parquet(f"{root}/pairs/batch={batch_id}")
        late = F.lit(False) if wait_s is None or last is None else F.coalesce(F.col("t") < last - wait_s, F.lit(False))
        for name, rows in (("waiting", ~hit & ~late), ("unmatched", ~hit & late)):
            left = near.where(rows).select("reading_id", "subject_id", "t")
            left.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")

    return each_batch(stream, checkpoint, work, trigger=trigger)


def paired(spark: SparkSession, root: str) -> DataFrame:
    """All pairs found so far; a reading sent again in a later batch keeps its first pair."""
    found = spark.read.schema(f"{PAIR_DDL}, batch bigint").parquet(f"{root}/pairs")
    first = F.min_by(F.struct("subject_id", "t", "session_id", "gap"), "batch")
    return found.groupBy("reading_id").agg(first.alias("p")).select("reading_id", "p.*")


def arriving_files(stream: DataFrame, good_root: str, quarantine_root: str, checkpoint: str, declared: DataFrame | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Check arriving files; accepted ones and the others go to separate tables.

    Declared files that have not come by a deadline are told by ``check_files`` over all that came.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        checked = check_files(batch, declared, missing=False)
        fine = F.col("verdict").isin("ok", "undeclared")
        # One folder per batch: a replayed batch overwrites itself.
        for root, rows in ((good_root, checked.where(fine)), (quarantine_root, checked.where(~fine))):
            rows.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return each_batch(stream, checkpoint, work, trigger=trigger)
