"""Is the data arriving: per-subject aggregates, pairing outcomes, backlog, recent rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wavecohort.functions import clock
from wavecohort.functions.values import short_id, subject_of, usable
from wavecohort.operators.intervals import PAIR_WINDOW_S, nearest_interval
from wavecohort.operators.scope import Scope, restrict, within_sessions
from wavecohort.schemas import STATS_DDL

# Thresholds of the collection rules.
MIN_RATE_SPAN_DAYS = 14.0
UPLOAD_IN_FLIGHT_S = 15 * 60.0
UPLOAD_ABANDONED_S = 36 * 3600.0
RECENT_ROWS = 15
RECENT_MARKERS = 20


def attribute_sessions(sessions: DataFrame, uploads: DataFrame) -> DataFrame:
    """Recordings with the subject and status of the upload they came from."""
    owner = uploads.select(
        F.col("phone_session_uuid").alias("session_uuid"),
        F.col("uploader_phone_id").alias("_uploader"),
        F.col("status").alias("upload_status"),
    )
    return (
        sessions.join(owner, "session_uuid", "left")
        .withColumn("subject_id", subject_of(F.col("_uploader")))
        .drop("_uploader")
    )


def place_readings(readings: DataFrame, tz: str, ambiguous: str = "later", on_error: str = "fail") -> DataFrame:
    """Readings with subject, wall epoch, corrected epoch ``t`` and clock state."""
    epoch = clock.wall_epoch(F.col("taken_at"), tz, ambiguous, on_error)
    return (
        readings.withColumn("subject_id", subject_of(F.col("uploader_phone_id")))
        .withColumn("wall_epoch", epoch)
        .withColumn("t", clock.corrected(F.col("wall_epoch"), F.col("clock_offset_s")))
        .withColumn(
            "clock_state",
            clock.clock_state(F.col("clock_offset_s"), F.col("clock_suspect"), F.col("clock_valid")),
        )
    )


def recordings_by_subject(attributed: DataFrame) -> DataFrame:
    seconds = clock.span_s(F.col("start_time"), F.col("end_time"))
    return attributed.groupBy("subject_id").agg(
        F.count("*").alias("sessions"),
        (F.coalesce(F.sum(seconds), F.lit(0.0)) / 3600.0).alias("recorded_hours"),
        F.max("start_time").alias("last_session_at"),
    )


def readings_by_subject(placed: DataFrame) -> DataFrame:
    return placed.groupBy("subject_id").agg(
        F.count("*").alias("cuff_readings"),
        F.max("taken_at").alias("last_cuff_taken_at"),
        F.max("uploaded_at").alias("last_cuff_transfer_at"),
        F.min("wall_epoch").alias("first_epoch"),
        F.max("wall_epoch").alias("last_epoch"),
    )


def observed_rate(by_subject: DataFrame) -> DataFrame:
    """Readings per day and the span it was seen over, only where that span is above half a day."""
    span = (F.coalesce("last_epoch", F.lit(0.0)) - F.coalesce("first_epoch", F.lit(0.0))) / clock.DAY_S
    seen = span > 0.5
    return by_subject.withColumns(
        {
            "cuff_per_day": F.when(seen, F.bround(F.col("cuff_readings") / span, 2)),
            "cuff_rate_span_days": F.when(seen, span),
        }
    )


def unsynced_projection(df: DataFrame) -> DataFrame:
    """Readings probably taken since the last transfer; null unless the rate is well founded."""
    founded = F.col("cuff_rate_span_days") >= MIN_RATE_SPAN_DAYS
    projected = F.col("cuff_per_day") * F.col("last_cuff_transfer_age_s") / clock.DAY_S
    return df.withColumn("estimated_unsynced_cuff", F.when(founded, F.bround(projected, 1)))


def reading_gaps(placed: DataFrame, attributed: DataFrame) -> DataFrame:
    """Every reading with its distance to the nearest recording of the same subject."""
    points = placed.select("reading_id", "subject_id", "clock_state", "t")
    return nearest_interval(points, attributed, "subject_id", "t", "start_time", "end_time", "id")


def reading_outcomes(gaps: DataFrame, tolerance: float = PAIR_WINDOW_S) -> DataFrame:
    """One outcome per reading: paired, outside every recording, or why its clock bars it."""
    outcome = F.when(F.col("clock_state") != "ok", F.concat(F.lit("clock_"), F.col("clock_state"))).when(
        F.col("gap") <= tolerance, "paired"
    ).otherwise("no_overlap")
    return gaps.withColumn("outcome", outcome)


def pair_outcomes(outcomes: DataFrame) -> DataFrame:
    is_ = lambda name: F.count_if(F.col("outcome") == name)
    return outcomes.groupBy("subject_id").agg(
        is_("paired").alias("pairs"),
        is_("no_overlap").alias("unpaired_no_overlap"),
        is_("clock_never_read").alias("unpaired_clock_never_read"),
        is_("clock_invalid").alias("unpaired_clock_invalid"),
        is_("clock_suspect").alias("unpaired_clock_suspect"),
        F.min(F.when(F.col("outcome") == "no_overlap", F.col("gap"))).alias("nearest_miss_s"),
    )


COUNTS = (
    "sessions",
    "cuff_readings",
    "pairs",
    "unpaired_no_overlap",
    "unpaired_clock_never_read",
    "unpaired_clock_invalid",
    "unpaired_clock_suspect",
)


def subject_state(recordings: DataFrame, readings: DataFrame, outcomes: DataFrame, now: float) -> DataFrame:
    """All per-subject facts in one row per subject, whichever tables the subject appears in."""
    parts = (
        recordings.unionByName(observed_rate(readings), allowMissingColumns=True)
        .unionByName(outcomes, allowMissingColumns=True)
    )
    facts = [c for c in parts.columns if c not in ("subject_id", "first_epoch", "last_epoch")]
    merged = parts.groupBy("subject_id").agg(*[F.max(c).alias(c) for c in facts])
    full = merged.withColumns(
        {
            **{c: F.coalesce(c, F.lit(0)) for c in COUNTS},
            "recorded_hours": F.bround(F.coalesce("recorded_hours", F.lit(0.0)), 2),
            "last_session_age_s": clock.age_s(F.col("last_session_at"), now),
            "last_cuff_transfer_age_s": clock.age_s(F.col("last_cuff_transfer_at"), now),
        }
    )
    return unsynced_projection(full).withColumn("cuff_rate_span_days", F.bround("cuff_rate_span_days", 2))


def clock_provenance(readings: DataFrame) -> DataFrame:
    measured = F.col("clock_offset_s").isNotNull()
    return readings.agg(
        F.count("*").alias("cuff_total"),
        F.count_if(measured).alias("with_provenance"),
        F.count_if(measured & ~clock.flag(F.col("clock_valid"))).alias("not_valid"),
        F.count_if(~measured).alias("no_provenance"),
        F.count_if(clock.flag(F.col("clock_suspect"))).alias("suspect"),
        F.max(F.abs("clock_offset_s")).alias("max_abs_offset_s"),
    )


def usable_minutes(minutes: DataFrame, threshold: float = 0.8, nan_is_good: bool = False) -> DataFrame:
    return minutes.agg(
        F.count("*").alias("minutes"),
        F.count_if(usable(F.col("sqi"), threshold, nan_is_good=nan_is_good)).alias("good_minutes"),
    )


def uploads_by_status(uploads: DataFrame) -> DataFrame:
    return uploads.groupBy("status").agg(F.count("*").alias("uploads"))


def upload_backlog(uploads: DataFrame, now: float) -> DataFrame:
    """Incomplete uploads by age: in flight, waiting, abandoned."""
    opened = F.col("opened_at")
    gone = opened < now - UPLOAD_ABANDONED_S
    alive = opened >= now - UPLOAD_ABANDONED_S
    totals = uploads.where(F.coalesce("status", F.lit("")) != "complete").agg(
        F.count("*").alias("total_incomplete"),
        F.count_if(opened >= now - UPLOAD_IN_FLIGHT_S).alias("in_flight"),
        F.count_if(gone).alias("abandoned"),
        F.min(F.when(alive, opened)).alias("_live_oldest"),
        F.min(opened).alias("_oldest"),
    )
    return totals.select(
        (F.col("total_incomplete") - F.col("abandoned")).alias("count"),
        clock.age_s(F.col("_live_oldest"), now).alias("oldest_age_s"),
        "in_flight",
        "abandoned",
        "total_incomplete",
        clock.age_s(F.col("_oldest"), now).alias("oldest_incomplete_age_s"),
    )


def table_totals(tables: dict[str, DataFrame], attributed: DataFrame, scope: Scope = None) -> DataFrame:
    """Row counts of the store, each within the viewer's scope."""
    scoped = {"sessions": restrict(attributed, F.col("subject_id"), scope)}
    for name in ("ppg", "acc", "gyro", "notes"):
        scoped[name] = within_sessions(tables[name], attributed, scope)
    scoped["cuff_readings"] = restrict(tables["cuff_readings"], F.col("uploader_phone_id"), scope)
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in scoped.items()
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def notes_per_session(attributed: DataFrame, notes: DataFrame) -> DataFrame:
    counted = notes.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("notes"))
    return attributed.join(counted, "id", "left").withColumn("notes", F.coalesce("notes", F.lit(0)))


def latest_sessions(sessions: DataFrame, k: int = RECENT_ROWS) -> DataFrame:
    """The ``k`` latest recordings, to be taken before any join where all may be seen."""
    return sessions.orderBy(F.desc_nulls_last("start_time"), "id").limit(k)


def recent_sessions(attributed: DataFrame, notes: DataFrame, k: int = RECENT_ROWS) -> DataFrame:
    """The ``k`` latest recordings; only their notes are counted."""
    latest = latest_sessions(attributed, k)
    noted = notes.select(F.col("session_id").alias("_of"))
    whole = F.struct(*[F.col(c) for c in latest.columns])
    counted = latest.select("id", whole.alias("s")).join(noted, F.col("id") == F.col("_of"), "left")
    counted = counted.groupBy("id", "s").agg(F.count("_of").alias("notes"))
    return counted.select("s.*", "notes").select(
        "id",
        short_id(F.col("session_uuid")).alias("uuid"),
        "start_time",
        clock.closed_span_s(F.col("start_time"), F.col("end_time")).alias("duration_s"),
        "device_name",
        "subject_id",
        F.col("upload_status").alias("status"),
        "notes",
    )


READING_VIEW = {
    "clock_valid": "clock_valid",
    "clock_suspect": "clock_suspect",
    "irregular": "ihb",
    "movement": "mov",
}


def reading_view(readings: DataFrame) -> DataFrame:
    """Readings as shown to people: flags defaulted to false and named for what they mean."""
    return readings.select(
        "reading_id",
        "taken_at",
        "sys",
        "dia",
        "pulse",
        subject_of(F.col("uploader_phone_id")).alias("subject_id"),
        "clock_offset_s",
        *[clock.flag(F.col(src)).alias(name) for name, src in READING_VIEW.items()],
    )


def recent_readings(readings: DataFrame, k: int = RECENT_ROWS) -> DataFrame:
    latest = readings.orderBy(F.desc_nulls_last("taken_at"), "reading_id").limit(k)
    return reading_view(latest)


# The note events that delimit a calibration run.
MARKER_EVENTS = ("calibration_start", "calibration_stop")


def note_fields(notes: DataFrame) -> DataFrame:
    """Fields of the JSON notes; text that does not parse gives nulls and is flagged."""
    field = lambda name: F.get_json_object("note", f"$.{name}")
    broken = F.col("note").isNotNull() & F.try_parse_json("note").isNull()
    return notes.select(
        "session_id",
        "ts",
        field("event").alias("event"),
        field("name").alias("name"),
        field("tags").alias("tags"),
        broken.alias("malformed"),
    )


def markers(notes: DataFrame, events: tuple[str, ...] = MARKER_EVENTS) -> DataFrame:
    return note_fields(notes).where(F.col("event").isin(*events)).drop("malformed")


def recent_markers(notes: DataFrame, k: int = RECENT_MARKERS) -> DataFrame:
    return markers(notes).orderBy(F.desc_nulls_last("ts"), "session_id").limit(k)


def malformed_notes(notes: DataFrame) -> DataFrame:
    return note_fields(notes).agg(F.count_if("malformed").alias("malformed_notes"), F.count("*").alias("notes"))


def newest_uploads(uploads: DataFrame, k: int = 100) -> DataFrame:
    return uploads.orderBy(F.desc_nulls_last("opened_at"), "phone_session_uuid").limit(k)


def upload_samples(uploads: DataFrame) -> DataFrame:
    """Samples of each upload from its conversion stats; null where these cannot be read."""
    stats = F.from_json("convert_stats_json", STATS_DDL, {"mode": "PERMISSIVE"})
    parsed = F.coalesce(F.try_parse_json("convert_stats_json").isNotNull(), F.lit(False))
    per_sensor = F.coalesce(F.map_values(stats["samples_per_sensor"]), F.array().cast("array<bigint>"))
    total = F.aggregate(per_sensor, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    empty = F.coalesce(F.col("convert_stats_json"), F.lit("")) == ""
    return uploads.withColumn(
        "samples", F.when(empty, F.lit(0).cast("bigint")).when(parsed, total)
    )


def last_activity(uploads: DataFrame, readings: DataFrame) -> DataFrame:
    """Latest conversion and latest reading transfer, as ISO-8601 UTC; null on an empty store."""
    ingest = uploads.agg(F.max("completed_at").alias("v")).select(F.lit("last_ingest_at").alias("what"), "v")
    sync = readings.agg(F.max("uploaded_at").alias("v")).select(F.lit("last_cuff_sync_at").alias("what"), "v")
    return ingest.unionByName(sync).select("what", clock.iso_utc(F.col("v")).alias("at"))


def subjects_with_readings(readings: DataFrame) -> DataFrame:
    return readings.select(subject_of(F.col("uploader_phone_id")).alias("subject_id")).distinct()


