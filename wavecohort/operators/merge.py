"""Idempotent merges of uploads and readings.

A merge is a union of the stored rows and the batch followed by one aggregation on the
key: no row is read twice, copies are combined before the shuffle, and the outcome does
not depend on how often a batch is sent.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wavecohort.schemas import FILL_ONCE

SEQ = "_seq"


def first_writer_merge(
    target: DataFrame,
    batch: DataFrame,
    key: Sequence[str],
    seq: Column,
    fill_once: Sequence[str] = FILL_ONCE,
    largest: Sequence[str] = (),
) -> DataFrame:
    """Stored rows win over the batch, earlier batch rows over later ones.

    ``seq`` orders the rows of the batch. Columns in ``fill_once`` take the first value
    that is not null, so a later row may fill a blank but never replace a value. Columns in ``largest``
    take the largest of all.
    """
    cols = [c for c in target.columns if c not in key]
    stored = target.withColumn(SEQ, F.struct(F.lit(0).alias("batch"), F.lit(None).cast(_type(batch, seq)).alias("at")))
    sent = batch.select(*target.columns, F.struct(F.lit(1).alias("batch"), seq.alias("at")).alias(SEQ))
    both = stored.unionByName(sent)
    first = [c for c in cols if c not in fill_once and c not in largest]
    whole = F.min_by(F.struct(*first), F.col(SEQ)).alias("_first")
    filled = [
        F.min_by(F.struct(c), F.when(F.col(c).isNotNull(), F.col(SEQ))).alias(f"_f_{c}")
        for c in cols
        if c in fill_once
    ]
    merged = both.groupBy(*key).agg(whole, *filled, *[F.max(c).alias(f"_l_{c}") for c in largest])
    value = lambda c: F.col(f"_first.{c}") if c in first else F.col(f"_l_{c}" if c in largest else f"_f_{c}.{c}")
    return merged.select(*[F.col(c) if c in key else value(c).alias(c) for c in target.columns])


def _type(df: DataFrame, column: Column) -> str:
    return df.select(column.alias("x")).schema["x"].dataType.simpleString()


def receipt(target: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many rows were received, how many keys are new, and the store's size after."""
    marked = target.select(*key, F.lit(0).alias("_sent")).unionByName(batch.select(*key, F.lit(1).alias("_sent")))
    per_key = marked.groupBy(*key).agg(F.sum("_sent").alias("_sent"), F.count("*").alias("_rows"))
    return per_key.agg(
        F.coalesce(F.sum("_sent"), F.lit(0)).alias("received"),
        F.count_if(F.col("_sent") == F.col("_rows")).alias("inserted"),
        F.count("*").alias("total"),
    )


def open_uploads(uploads: DataFrame, requests: DataFrame, opened_at: Column) -> DataFrame:
    """Audit rows for upload requests whose id is not known yet; the first request of an id counts."""
    first = requests.groupBy("phone_session_uuid").agg(
        F.min_by(F.struct("uploader_phone_id", "device_name", opened_at.alias("opened_at")), opened_at).alias("r")
    )
    fresh = first.join(uploads.select("phone_session_uuid"), "phone_session_uuid", "left_anti")
    return fresh.select(
        "phone_session_uuid",
        "r.uploader_phone_id",
        "r.device_name",
        "r.opened_at",
        F.lit(None).cast("double").alias("completed_at"),
        F.lit("open").alias("status"),
        F.lit("{}").alias("files_json"),
        F.lit(None).cast("string").alias("convert_stats_json"),
    )


def latest_status(log: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """Current state of each key from its append-only event log."""
    newest = F.max_by(F.struct(*values), F.struct(F.col(at), *values))
    return log.groupBy(key).agg(newest.alias("_v"), F.max(at).alias(at)).select(key, at, "_v.*")


def last_file_facts(staged: DataFrame, key: str, name: str, at: str) -> DataFrame:
    """Hash and size last staged under each file name of each upload."""
    newest = F.max_by(F.struct("sha256", "bytes"), F.struct(F.col(at), F.col("sha256"), F.col("bytes")))
    return staged.groupBy(key, name).agg(newest.alias("_v")).select(key, name, "_v.*")


def drop_repeats(samples: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples without exact copies, also of what is ``stored``, and how many rows were copies.

    Different samples of one moment all stay.
    """
    columns = samples.columns
    once = samples.groupBy(*columns).agg(F.count("*").alias("_n"))
    if stored is None:
        once = once.withColumn("_old", F.lit(None).cast("boolean"))
    else:
        known = stored.select(*[F.col(c).alias(f"_{n}") for n, c in enumerate(columns)]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{n}")) for n, c in enumerate(columns)])
        once = once.join(known.withColumn("_old", F.lit(True)), same, "left").select(*columns, "_n", "_old")
    kept = F.when(F.col("_old").isNull(), 1).otherwise(0)
    return once.where(F.col("_old").isNull()).select(*columns), once.agg(F.sum(F.col("_n") - kept).alias("duplicates"))
