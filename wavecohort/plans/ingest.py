"""Ingest: landed bundles to sample tables, reading batches to the readings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from wavecohort.operators.merge import drop_repeats, first_writer_merge, latest_status, receipt
from wavecohort.schemas import STATS_DDL, sample_schema, schema_of
from wavecohort.session import durable
from wavecohort.sources import buckets, bundles


RECEIPT_DDL = "received bigint, inserted bigint, total bigint"


def stored_schema() -> StructType:
    """Stored readings carry when they were last sent, beside ``uploaded_at``, which stays at the first arrival."""
    return schema_of("cuff_readings").add("last_seen_at", "double")


def _seen(batch: DataFrame) -> DataFrame:
    return batch.withColumn("last_seen_at", F.col("uploaded_at"))


def stored_readings(spark: SparkSession, root: str) -> DataFrame:
    """The readings that ``ingest_readings`` has merged so far."""
    return buckets.read_buckets(spark, f"{root}/table", stored_schema())


def ingest_readings(spark: SparkSession, root: str, batch: DataFrame, seq: Column) -> DataFrame:
    """Merge a batch of readings into the stored table and return the receipt.

    Only the buckets that the batch's readings fall into are read and written again. The store's size is
    the one before plus what is new, so that no other bucket is counted.
    """
    batch = durable(_seen(batch).withColumn("_order", seq), "readings")
    done = buckets.generations(spark, f"{root}/table")
    number = done[-1] + 1 if done else 1
    counted = buckets._listed(spark, f"{root}/receipts", "gen")
    last = [n for n in counted if n < number][-1:]
    before = spark.read.schema(RECEIPT_DDL).parquet(*[f"{root}/receipts/gen={n}" for n in last]).first().total if last else 0
    touched = [r[0] for r in batch.select(buckets.bucket_of(["reading_id"])).distinct().collect()]
    near = buckets.read_buckets(spark, f"{root}/table", stored_schema(), touched, number)
    counts = receipt(near, batch, ["reading_id"]).withColumn("total", F.col("inserted") + before)
    counts.write.mode("overwrite").parquet(f"{root}/receipts/gen={number}")
    merge = lambda old, new: first_writer_merge(old, new, ["reading_id"], F.col("_order"), largest=["last_seen_at"])
    buckets.merge_buckets(batch, f"{root}/table", stored_schema(), ["reading_id"], merge, number)
    buckets.prune(spark, f"{root}/table")
    return spark.read.schema(RECEIPT_DDL).parquet(f"{root}/receipts/gen={number}")


def log_readings(batch: DataFrame, root: str, number: int) -> None:
    """Append a batch to the readings log; the same number written again replaces itself."""
    buckets.log_batch(batch, root, number)


def _folding(seq: Column):
    order = F.struct("batch", seq.alias("seq"))
    return lambda old, new: first_writer_merge(old, _seen(new), ["reading_id"], order, largest=["last_seen_at"])


def merged_readings(spark: SparkSession, root: str, seq: Column) -> DataFrame:
    """The readings table: what was folded, then the batches since then, in batch order.

    ``seq`` orders rows within a batch. ``last_seen_at`` is when a reading was last sent; a batch that is
    written again after it was folded changes nothing.
    """
    return _folding(seq)(stored_readings(spark, root), buckets.unfolded(spark, root, schema_of("cuff_readings")))


def compact_readings(spark: SparkSession, root: str, seq: Column) -> None:
    """Fold the log into the buckets of the readings it names, then delete the folded batches."""
    buckets.fold(spark, root, stored_schema(), schema_of("cuff_readings"), ["reading_id"], _folding(seq))


def sessions_from_manifests(manifests: DataFrame) -> DataFrame:
    """Recordings described by the manifests; the id is a hash of the upload's own id."""
    return manifests.select(
        F.abs(F.xxhash64("session_uuid")).alias("id"),
        "session_uuid",
        F.col("started_at").alias("start_time"),
        F.col("ended_at").alias("end_time"),
        "device_name",
        F.lit(None).cast("string").alias("device_address"),
        F.to_json("settings").alias("settings"),
        "epoch_offset_ns",
        "rotation_period_minutes",
    )


def convert_bundles(spark: SparkSession, landing: str, fmt: str = "parquet", sensors: tuple[str, ...] = ("ppg", "acc", "gyro"), stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Rows of the store for all bundles below ``landing``, and what each bundle held.

    Exact copies of a sample, note or segment are dropped and counted, so that a bundle sent twice counts
    once; for samples, with ``stored`` (sample tables by sensor) also those sent in an earlier run. Sensors without a
    table of their own (``mag``, ``ppi``, any name) come in one layout; their samples without a time are set aside. What belongs to
    a bundle without a readable manifest is set aside in ``broken_<table>``, and
    ``failed`` names those bundles: landed rows are kept, dropped as copies or set aside.
    """
    read = bundles.read_manifests(spark, landing)
    manifests = read.where(F.col("session_uuid").isNotNull())
    sessions = sessions_from_manifests(manifests).dropDuplicates(["session_uuid"])
    ids = manifests.select("bundle", "session_uuid", F.abs(F.xxhash64("session_uuid")).alias("session_id"))
    known = ids.select("bundle").distinct()
    out: dict[str, DataFrame] = {"sessions": sessions}
    failed = read.where(F.col("session_uuid").isNull()).select("bundle", F.col(bundles.CORRUPT).alias("reason"))
    per_sensor = {}
    repeats = None
    for sensor in sensors:
        landed = bundles.read_samples(spark, landing, sensor, fmt)
        timed = F.lit(True) if "sensor" not in landed.columns else F.col("timestamp_ns").isNotNull()
        out[f"broken_{sensor}"] = landed.join(known, "bundle", "left_anti").unionByName(landed.where(~timed).join(known, "bundle", "left_semi"))
        placed = landed.where(timed).join(ids, "bundle").drop("bundle", "session_uuid")
        names = [f.name for f in sample_schema(sensor).fields]
        earlier = None if stored is None or sensor not in stored else stored[sensor].select(*names)
        kept, lost = drop_repeats(placed.select(*names), earlier)
        kept = durable(kept, sensor)
        out[sensor] = kept.select(*[f.name for f in sample_schema(sensor).fields])
        per_sensor[sensor] = out[sensor].join(
            ids.select("session_id", "session_uuid").distinct(), "session_id"
        )
        lost = lost.withColumn("sensor", F.lit(sensor))
        repeats = lost if repeats is None else repeats.unionByName(lost)
    all_notes = bundles.read_notes(spark, landing).unionByName(bundles.read_notes(spark, landing, "csv"))
    all_segments = bundles.read_segments(spark, landing)
    out["broken_notes"] = all_notes.join(known, "bundle", "left_anti")
    out["broken_segments"] = all_segments.join(known, "bundle", "left_anti")
    notes, again = drop_repeats(all_notes.join(ids.select("bundle", "session_id"), "bundle").drop("bundle"))
    repeats = repeats.unionByName(again.withColumn("sensor", F.lit("notes")))
    segments, again = drop_repeats(all_segments.join(ids.select("bundle", "session_uuid"), "bundle").drop("bundle"))
    repeats = repeats.unionByName(again.withColumn("sensor", F.lit("segments")))
    # Bundles that landed files but no manifest fail like those whose manifest can't be read.
    homeless = [out[n].select("bundle") for n in out if n.startswith("broken_")]
    for one in homeless:
        lone = one.distinct().join(read.select("bundle").distinct(), "bundle", "left_anti")
        failed = failed.unionByName(lone.withColumn("reason", F.lit("no manifest")))
    out["failed"] = failed.groupBy("bundle").agg(F.max("reason").alias("reason"))
    out["notes"] = notes.select("session_id", "ts", "note")
    out["segments"] = segments.select("session_uuid", "event", "segment_id", "ts")
    out["duplicates"] = repeats
    out["stats"] = conversion_stats(manifests, per_sensor, notes, segments)
    return out


def conversion_stats(manifests: DataFrame, samples: dict[str, DataFrame], notes: DataFrame, segments: DataFrame) -> DataFrame:
    """Samples per sensor, segments, notes and sample files of each bundle, also as JSON text."""
    counted = lambda df, key, name: df.groupBy(key).agg(F.count("*").alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    base = manifests.select(
        "session_uuid",
        F.abs(F.xxhash64("session_uuid")).alias("session_id"),
        F.coalesce(F.size("rop_files"), F.lit(0)).cast("bigint").alias("rop_files"),
    ).dropDuplicates(["session_uuid"])
    joined = (
        base.join(bundles.sample_counts(samples), "session_uuid", "left")
        .join(counted(segments, "session_uuid", "segments"), "session_uuid", "left")
        .join(counted(notes, "session_id", "notes"), "session_id", "left")
        .select("session_uuid", "samples_per_sensor", zero("segments"), zero("notes"), "rop_files", F.col("session_id").alias("db_session_id"))
    )
    fields = [f.split()[0] for f in STATS_DDL.split(", ")]
    return joined.withColumn("convert_stats_json", F.to_json(F.struct(*fields)))


def completed_uploads(uploads: DataFrame, finished: DataFrame) -> DataFrame:
    """Audit rows after conversion.

    ``finished`` has phone_session_uuid, completed_at, status and convert_stats_json, one
    row per attempt; the latest attempt counts.
    """
    latest = latest_status(finished, "phone_session_uuid", "completed_at", "status", "convert_stats_json")
    renamed = latest.select("phone_session_uuid", *[F.col(c).alias(f"_n_{c}") for c in ("completed_at", "status", "convert_stats_json")])
    good = F.col("_n_status") == "complete"
    return uploads.join(renamed, "phone_session_uuid", "left").select(
        "phone_session_uuid",
        "uploader_phone_id",
        "device_name",
        "opened_at",
        F.when(good, F.col("_n_completed_at")).otherwise(F.col("completed_at")).alias("completed_at"),
        F.coalesce("_n_status", "status").alias("status"),
        "files_json",
        F.when(good, F.col("_n_convert_stats_json")).otherwise(F.col("convert_stats_json")).alias("convert_stats_json"),
    )

