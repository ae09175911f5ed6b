"""Waveforms of many recordings at once, one result row per requested recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wavecohort.functions.values import finite
from wavecohort.operators import signal as s
from wavecohort.operators.scope import Scope, scoped_session_ids
from wavecohort.session import durable

KEY = ["session_id"]


def _curve(*columns: str) -> list:
    """Aggregates that gather at most a cap of points per key into arrays in time order."""
    ordered = F.array_sort(F.collect_list(F.struct("order", *columns)))
    return [ordered[name].alias(name) for name in columns]


def waveforms(
    requested: DataFrame,
    sessions: DataFrame,
    ppg: DataFrame,
    motion: DataFrame,
    attributed: DataFrame | None = None,
    scope: Scope = None,
    cap: int = s.MAX_POINTS,
) -> DataFrame:
    """Pulse, beats and motion of the ``requested`` recordings.

    A recording that does not exist and one outside the scope look the same: not found.
    ``motion`` holds acc and gyro samples told apart by ``sensor``.
    """
    asked = requested.select("session_id").distinct()
    known = sessions.select(F.col("id").alias("session_id"), finite(F.col("start_time"), 3).alias("start_time"), "device_name")
    if attributed is not None and scope is not None:
        known = known.join(scoped_session_ids(attributed, scope), "session_id", "left_semi")
    found = asked.join(known, "session_id")
    wanted = lambda df: df.join(found.select("session_id"), "session_id", "left_semi")

    indexed = s.sample_index(s.optical_channels(wanted(ppg)), KEY, s.CHANNELS)
    signal = s.chosen_signal(durable(s.pulse_band(indexed, KEY), "band"), KEY)
    pulse = s.envelope(signal, KEY, "y", cap, extra=["fs", "channel"]).withColumn("order", F.col("bucket"))
    digits = {"t_s": 3, "lo": 3, "hi": 3}
    pulse = pulse.withColumns({c: finite(F.col(c), d) for c, d in digits.items()})
    pulse_block = pulse.groupBy(*KEY).agg(
        finite(F.max("fs"), 1).alias("fs_hz"),
        F.max("channel").alias("channel"),
        *_curve("t_s", "lo", "hi"),
    ).select("session_id", F.struct("fs_hz", "channel", "t_s", "lo", "hi").alias("ppg"))

    beats = durable(s.beat_intervals(s.merge_peaks(s.peak_candidates(signal, KEY), KEY), KEY), "beats")
    kept = s.thin_evenly(beats.where("valid"), KEY, cap).select(
        "session_id", F.col("i").alias("order"), finite(F.col("t_s"), 3).alias("t_s"), finite(F.col("bpm"), 1).alias("bpm")
    )
    rates = kept.groupBy(*KEY).agg(*_curve("t_s", "bpm"))
    none = F.array().cast("array<double>")
    hr_block = s.beat_summary(beats, KEY).join(rates, KEY, "left").select(
        "session_id",
        F.struct(
            F.coalesce("t_s", none).alias("t_s"), F.coalesce("bpm", none).alias("bpm"), "n_beats", "mean_bpm"
        ).alias("hr"),
    )

    moved = s.motion_envelope(wanted(motion), ["sensor", "session_id"], cap).withColumn("order", F.col("bucket"))
    moved = moved.withColumns({c: finite(F.col(c), d) for c, d in digits.items()})
    moved = moved.groupBy("session_id", "sensor").agg(
        finite(F.max("fs"), 1).alias("fs_hz"), *_curve("t_s", "lo", "hi")
    ).withColumn("block", F.struct("fs_hz", "t_s", "lo", "hi"))
    motion_block = moved.groupBy(*KEY).agg(
        *[F.max(F.when(F.col("sensor") == name, F.col("block"))).alias(name) for name in ("acc", "gyro")]
    )
    return (
        asked.join(found.withColumn("found", F.lit(True)), "session_id", "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
        .join(pulse_block, "session_id", "left")
        .join(motion_block, "session_id", "left")
        .join(hr_block, "session_id", "left")
    )
