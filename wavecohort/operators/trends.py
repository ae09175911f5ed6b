"""What the data looks like over time: points, days, hours, runs, agreement.

Series belong to one subject each and are never merged; no pressure is ever derived from
the optical signal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wavecohort.functions import clock
from wavecohort.functions.values import below, finite, usable
from wavecohort.operators.intervals import PAIR_HR_WINDOW_S, PAIR_WINDOW_S, band_average, containing_interval
from wavecohort.operators.ordered import gap_runs, rank_select, top_per_group

# Caps, gaps and limits of the series.
MAX_POINTS = 5000
READING_GAP_S = 36 * 3600
QUALITY_GAP_S = 3 * 3600
BEAT_GAP_S = 5
DETAIL_LIMIT = 40
LOW_SYSTOLIC = 90


def reading_points(placed: DataFrame, now: float, days: int | None = None) -> DataFrame:
    """Corrected reading points that were not quarantined."""
    kept = placed.where(clock.not_quarantined(F.col("clock_suspect"))).where(
        clock.since_wall(F.col("taken_at"), F.col("wall_epoch"), now, days)
    )
    return kept.select(
        "reading_id",
        finite(F.col("t")).alias("ts"),
        "sys",
        "dia",
        "pulse",
        "subject_id",
        clock.flag(F.col("clock_valid")).alias("clock_ok"),
        clock.flag(F.col("ihb")).alias("irregular"),
    )


def newest_points(points: DataFrame, cap: int = MAX_POINTS) -> DataFrame:
    """The newest ``cap`` points of each subject, for a drawing that shows no more."""
    return top_per_group(points, ["subject_id"], [F.desc("ts"), F.desc("reading_id")], cap)


def recorded_by_day(attributed: DataFrame, tz: str, now: float, days: int | None = None) -> DataFrame:
    """Minutes and recordings per day and subject; a recording belongs whole to its first day."""
    kept = attributed.where(clock.since_days(F.col("start_time"), now, days))
    return kept.groupBy(clock.local_day(F.col("start_time"), tz).alias("day"), "subject_id").agg(
        (F.sum(clock.span_s(F.col("start_time"), F.col("end_time"))) / 60.0).alias("recorded_minutes"),
        F.count("*").alias("sessions"),
    )


def readings_by_day(placed: DataFrame, now: float, days: int | None = None) -> DataFrame:
    kept = placed.where(clock.since_wall(F.col("taken_at"), F.col("wall_epoch"), now, days))
    return kept.groupBy(F.substring("taken_at", 1, 10).alias("day"), "subject_id").agg(
        F.count("*").alias("cuff_count")
    )


def coverage_days(recorded: DataFrame, read: DataFrame) -> DataFrame:
    """Days with a recording or a reading; what is missing on the other side is zero."""
    return recorded.join(read, ["day", "subject_id"], "full_outer").select(
        "day",
        "subject_id",
        F.coalesce(finite(F.col("recorded_minutes"), 1), F.lit(0.0)).alias("recorded_minutes"),
        F.coalesce("sessions", F.lit(0)).alias("sessions"),
        F.coalesce("cuff_count", F.lit(0)).alias("cuff_count"),
    )


def calendar(coverage: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Every day of the window for every subject; days without data are zero."""
    days = F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"), F.expr("interval 1 day"))
    grid = coverage.select("subject_id").distinct().select(
        "subject_id", F.explode(days).alias("day")
    ).withColumn("day", F.col("day").cast("string"))
    return grid.join(coverage, ["day", "subject_id"], "left").select(
        "day",
        "subject_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("recorded_minutes", "sessions", "cuff_count")],
    )


def coverage_totals(coverage: DataFrame) -> DataFrame:
    """Coverage summed over subjects per day, with the largest day as share of scale."""
    per_day = coverage.groupBy("day").agg(
        F.sum("recorded_minutes").alias("minutes"), F.sum("cuff_count").alias("cuff")
    )
    # One row per calendar day is left here, so one frame over all of them stays small.
    largest = F.max("minutes").over(Window.partitionBy(F.lit(0)))
    return per_day.withColumn("scale_max", F.greatest(F.lit(10.0), largest))


def hourly_quality(minutes: DataFrame, now: float, days: int | None = None, keys: tuple[str, ...] = (), skip_nan: bool = False, digits: tuple[int, int, int] = (3, 1, 2)) -> DataFrame:
    """Mean quality, heart rate and motion per hour; a NaN minute blanks its hour unless skipped."""
    kept = minutes.where(clock.since_days(F.col("ts"), now, days))
    number = lambda c: F.when(~F.isnan(c), F.col(c)) if skip_nan else F.col(c)
    hour = (F.floor(F.col("ts") / 3600.0) * 3600).cast("double").alias("bucket")
    return kept.groupBy(hour, *keys).agg(
        finite(F.avg(number("sqi")), digits[0]).alias("sqi"),
        finite(F.avg(number("hr_ppg")), digits[1]).alias("hr"),
        F.count("*").alias("minutes"),
        finite(F.avg(number("acc_motion")), digits[2]).alias("motion"),
    )


def daily_summary(points: DataFrame, tz: str) -> DataFrame:
    """Daily medians with their spread, and the time of the day's middle reading.

    Medians are over small integers, so they merge as value counts; the middle reading is
    found by rank from counts as well.
    """
    keys = ["subject_id", "day"]
    daily = points.withColumn("day", clock.local_day(F.col("ts"), tz))
    figures = daily.groupBy(*keys).agg(
        F.median("sys").alias("sys"),
        F.median("dia").alias("dia"),
        F.min("sys").alias("sys_lo"),
        F.max("sys").alias("sys_hi"),
        F.median("pulse").alias("pulse"),
        F.count("*").alias("n"),
        F.bool_or(below(F.col("sys"), LOW_SYSTOLIC)).alias("any_low"),
    )
    middle = rank_select(daily, keys, "ts", {"ts": F.expr("n div 2")}, 60.0)
    return figures.join(middle, keys)


def adaptive_points(points: DataFrame, tz: str, detail_limit: int = DETAIL_LIMIT) -> DataFrame:
    """Single readings for subjects with few points, daily medians for the others.

    No per-subject count is joined back to the readings: one reading above the limit is
    enough to tell a subject that has too many, and the days know their own totals.
    """
    key = Window.partitionBy("subject_id")
    few = top_per_group(points, ["subject_id"], [F.asc("ts"), F.asc("reading_id")], detail_limit + 1)
    single = few.withColumn("_n", F.count("*").over(key)).where(F.col("_n") <= detail_limit).select(
        "subject_id",
        "ts",
        *[F.col(c).cast("double").alias(c) for c in ("sys", "dia", "pulse")],
        F.col("sys").alias("sys_lo"),
        F.col("sys").alias("sys_hi"),
        F.lit(1).cast("bigint").alias("n"),
        below(F.col("sys"), LOW_SYSTOLIC).alias("any_low"),
        F.lit(False).alias("aggregated"),
    )
    days = daily_summary(points, tz).withColumn("_n", F.sum("n").over(key)).where(F.col("_n") > detail_limit)
    return single.unionByName(days.withColumn("aggregated", F.lit(True)).drop("day", "_n"))


def hour_of_day(points: DataFrame, tz: str) -> DataFrame:
    return points.withColumn("hour", clock.local_hour(F.col("ts"), tz)).withColumn(
        "low", below(F.col("sys"), LOW_SYSTOLIC)
    )


def hour_profile(points: DataFrame, tz: str) -> DataFrame:
    """Median pressure per subject and whole hour of the local day."""
    hourly = hour_of_day(points, tz).withColumn("hour", F.floor("hour").cast("int"))
    return hourly.groupBy("subject_id", "hour").agg(
        F.median("sys").alias("sys"), F.median("dia").alias("dia"), F.count("*").alias("n")
    )


def run_summary(df: DataFrame, keys: list[str], ts: str, gap: float) -> DataFrame:
    """Runs of points without a gap: their bounds and sizes."""
    return gap_runs(df.select(*keys, ts), keys, ts, gap).groupBy(*keys, "run").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("points")
    )


def quality_flags(hourly: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Hours that have a quality value, flagged usable from the threshold on."""
    return hourly.where(F.col("sqi").isNotNull()).withColumn(
        "usable", usable(F.col("sqi"), threshold, inclusive=True)
    )


def pair_points(
    placed: DataFrame,
    attributed: DataFrame,
    minutes: DataFrame | None,
    require_offset: bool = True,
    by_subject: bool = True,
    tolerance: float = PAIR_WINDOW_S,
    half_width: float = PAIR_HR_WINDOW_S,
) -> DataFrame:
    """Readings inside a recording with the optical heart rate and quality around them.

    Minutes are matched within the subject where they carry one; ``by_subject=False``
    averages the minutes of all subjects.
    """
    trusted = placed.where(
        clock.clock_trusted(
            F.col("clock_offset_s"), F.col("clock_suspect"), F.col("clock_valid"), require_offset
        )
    ).select("reading_id", "t", "sys", "dia", "pulse", "subject_id")
    inside = containing_interval(
        trusted, attributed, "subject_id", "t", "start_time", "end_time", "id", tolerance
    )
    if minutes is None:
        nothing = F.lit(None).cast("double")
        averaged = inside.withColumns({"hr_ppg": nothing, "sqi": nothing})
    else:
        keys = ["subject_id"] if by_subject and "subject_id" in minutes.columns else []
        averaged = band_average(
            inside, minutes, keys, "reading_id", "t", "ts", ["hr_ppg", "sqi"], half_width
        )
    return averaged.select(
        "reading_id",
        finite(F.col("t")).alias("ts"),
        "sys",
        "dia",
        "pulse",
        "subject_id",
        "session_id",
        finite(F.col("hr_ppg"), 1).alias("hr_ppg"),
        finite(F.col("sqi"), 3).alias("sqi"),
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """Optical heart rate against cuff pulse: points on the identity line have difference zero."""
    both = pairs.where(F.col("hr_ppg").isNotNull())
    return both.withColumn("difference", F.col("hr_ppg") - F.col("pulse")).withColumn(
        "mean_of_both", (F.col("hr_ppg") + F.col("pulse")) / 2.0
    )


def agreement_limits(pairs: DataFrame) -> DataFrame:
    """Mean difference and its 95 % limits per subject."""
    spread = F.stddev_samp("difference")
    return agreement(pairs).groupBy("subject_id").agg(
        F.count("*").alias("n"),
        F.avg("difference").alias("bias"),
        (F.avg("difference") - 1.96 * spread).alias("lower"),
        (F.avg("difference") + 1.96 * spread).alias("upper"),
    )
