"""Collection status: subjects, pairing, backlog, recent rows, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.views import NOW, TZ, sql, store, view
from wavecohort.functions import clock, values
from wavecohort.operators import collection as c, rules, scope

QUERIES = {}
ORACLE = {}


def query(counterpart: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if counterpart is not None:
            ORACLE[fn.__name__] = counterpart
        return fn

    return keep


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return c.place_readings(view(spark, sf, "readings"), TZ)


def attributed(spark: SparkSession, sf: str) -> DataFrame:
    return c.attribute_sessions(view(spark, sf, "sessions"), view(spark, sf, "uploads"))


LATER = NOW + 25 * 86400  # a store nobody has fed for 25 days, so that the age rules fire


def state(spark: SparkSession, sf: str, now: float = NOW) -> DataFrame:
    where, who = attributed(spark, sf), placed(spark, sf)
    outcomes = c.pair_outcomes(c.reading_outcomes(c.reading_gaps(who, where)))
    return c.subject_state(c.recordings_by_subject(where), c.readings_by_subject(who), outcomes, now)


# ---- shared CTEs of the counterparts

ATT = """, att AS (
  SELECT s.*, coalesce(nullif(u.uploader_phone_id, ''), 'unknown') AS subject_id, u.status AS upload_status
  FROM sessions s LEFT JOIN uploads u ON u.phone_session_uuid = s.session_uuid)"""
PLC = f""", plc AS (
  SELECT r.*, coalesce(nullif(uploader_phone_id, ''), 'unknown') AS subject_id,
         epoch(timezone('{TZ}', CAST(taken_at AS TIMESTAMP))) AS wall_epoch,
         epoch(timezone('{TZ}', CAST(taken_at AS TIMESTAMP))) - coalesce(clock_offset_s, 0) AS t,
         CASE WHEN clock_offset_s IS NULL THEN 'never_read' WHEN coalesce(clock_suspect, FALSE) THEN 'suspect'
              WHEN NOT coalesce(clock_valid, FALSE) THEN 'invalid' ELSE 'ok' END AS clock_state
  FROM readings r)"""
GAP = """, near AS (
  SELECT p.reading_id, p.subject_id, p.clock_state, p.t, a.id,
         greatest(a.start_time - p.t, p.t - coalesce(a.end_time, a.start_time), 0) AS gap,
         row_number() OVER (PARTITION BY p.reading_id ORDER BY
           greatest(a.start_time - p.t, p.t - coalesce(a.end_time, a.start_time), 0),
           coalesce(a.end_time, a.start_time) DESC, a.id) AS rn
  FROM plc p LEFT JOIN att a ON a.subject_id = p.subject_id),
gaps AS (SELECT reading_id, subject_id, clock_state, t, CASE WHEN id IS NOT NULL THEN gap END AS gap,
                id AS matched_id FROM near WHERE rn = 1)"""
#: The recording that holds a reading: the smallest gap, then the smallest id.
HELD = """, held AS (SELECT reading_id, arg_min(id, (gap, id)) AS session_id, min(gap) AS gap
  FROM near WHERE id IS NOT NULL AND gap <= 120 GROUP BY 1)"""
OUT = """, outc AS (
  SELECT subject_id,
         count(*) FILTER (WHERE clock_state = 'ok' AND gap <= 120) AS pairs,
         count(*) FILTER (WHERE clock_state = 'ok' AND (gap IS NULL OR gap > 120)) AS unpaired_no_overlap,
         count(*) FILTER (WHERE clock_state = 'never_read') AS unpaired_clock_never_read,
         count(*) FILTER (WHERE clock_state = 'invalid') AS unpaired_clock_invalid,
         count(*) FILTER (WHERE clock_state = 'suspect') AS unpaired_clock_suspect,
         min(gap) FILTER (WHERE clock_state = 'ok' AND gap > 120) AS nearest_miss_s
  FROM gaps GROUP BY 1)"""
RBS = """, rec AS (
  SELECT subject_id, count(*) AS sessions,
         coalesce(sum(coalesce(end_time, start_time) - start_time), 0) / 3600 AS recorded_hours,
         max(start_time) AS last_session_at FROM att GROUP BY 1),
red AS (
  SELECT subject_id, count(*) AS cuff_readings, max(taken_at) AS last_cuff_taken_at,
         max(uploaded_at) AS last_cuff_transfer_at, min(wall_epoch) AS first_epoch,
         max(wall_epoch) AS last_epoch FROM plc GROUP BY 1),
rate AS (
  SELECT *, (last_epoch - first_epoch) / 86400 AS span,
         CASE WHEN (last_epoch - first_epoch) / 86400 > 0.5
              THEN round_even(cuff_readings / ((last_epoch - first_epoch) / 86400), 2) END AS cuff_per_day,
         CASE WHEN (last_epoch - first_epoch) / 86400 > 0.5
              THEN (last_epoch - first_epoch) / 86400 END AS cuff_rate_span_days FROM red)"""
STA = f""", ids AS (SELECT subject_id FROM rec UNION SELECT subject_id FROM red),
stt AS (
  SELECT i.subject_id, coalesce(sessions, 0) AS sessions,
         round_even(coalesce(recorded_hours, 0), 2) AS recorded_hours, last_session_at,
         greatest(0, {NOW} - last_session_at) AS last_session_age_s,
         coalesce(cuff_readings, 0) AS cuff_readings, last_cuff_taken_at, last_cuff_transfer_at,
         greatest(0, {NOW} - last_cuff_transfer_at) AS last_cuff_transfer_age_s, cuff_per_day,
         round_even(cuff_rate_span_days, 2) AS cuff_rate_span_days,
         coalesce(pairs, 0) AS pairs, coalesce(unpaired_no_overlap, 0) AS unpaired_no_overlap,
         coalesce(unpaired_clock_never_read, 0) AS unpaired_clock_never_read,
         coalesce(unpaired_clock_invalid, 0) AS unpaired_clock_invalid,
         coalesce(unpaired_clock_suspect, 0) AS unpaired_clock_suspect, nearest_miss_s,
         CASE WHEN cuff_rate_span_days >= 14
              THEN round_even(cuff_per_day * greatest(0, {NOW} - last_cuff_transfer_at) / 86400, 1) END
           AS estimated_unsynced_cuff
  FROM ids i LEFT JOIN rec USING (subject_id) LEFT JOIN rate USING (subject_id) LEFT JOIN outc USING (subject_id))"""
# An age is null where there is nothing to be old; greatest() alone would say zero.
STA = STA.replace(
    f"greatest(0, {NOW} - last_session_at)",
    f"CASE WHEN last_session_at IS NOT NULL THEN greatest(0, {NOW} - last_session_at) END",
).replace(
    f"greatest(0, {NOW} - last_cuff_transfer_at) AS",
    f"CASE WHEN last_cuff_transfer_at IS NOT NULL THEN greatest(0, {NOW} - last_cuff_transfer_at) END AS",
)
ALL_STATE = ATT + PLC + GAP + OUT + RBS + STA


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---- predicates and projections

@query(sql("readings", PLC + " SELECT reading_id, wall_epoch FROM plc"))
def b1_wall_clock_epoch(spark, sf):
    return placed(spark, sf).select("reading_id", "wall_epoch")


@query(sql("readings", PLC + " SELECT reading_id, round(t, 6) AS t FROM plc"))
def b2_corrected_time(spark, sf):
    return placed(spark, sf).select("reading_id", F.round("t", 6).alias("t"))


@query(sql("readings", PLC + " SELECT clock_state, count(*) AS n FROM plc GROUP BY 1"))
def b3_clock_state(spark, sf):
    return placed(spark, sf).groupBy("clock_state").agg(F.count("*").alias("n"))


@query(sql("readings", PLC + " SELECT subject_id, count(*) AS n FROM plc GROUP BY 1"))
def b4_subject_default(spark, sf):
    return placed(spark, sf).groupBy("subject_id").agg(F.count("*").alias("n"))


@query(sql("readings", PLC + " SELECT reading_id, subject_id FROM plc WHERE subject_id IN ('p03', 'unknown')"))
def b5_subject_scope(spark, sf):
    kept = scope.restrict(view(spark, sf, "readings"), F.col("uploader_phone_id"), ["p03", "unknown"])
    return kept.select("reading_id", values.subject_of(F.col("uploader_phone_id")).alias("subject_id"))


GRANTED = """, g AS (SELECT DISTINCT viewer, coalesce(subject, '*') AS subject_id FROM grants
  WHERE trim(coalesce(subject, '*')) <> '')"""


@query(sql("grants", GRANTED + " SELECT viewer, subject_id FROM g"))
def b6_grant_resolution(spark, sf):
    return scope.resolve_grants(view(spark, sf, "grants"), "viewer", "subject")


@query(sql("grants readings", GRANTED + PLC + """
  SELECT g.viewer, bool_or(g.subject_id = '*') AS sees_all,
         CASE WHEN bool_or(g.subject_id = '*') THEN (SELECT count(*) FROM plc)
              ELSE coalesce(sum(n), 0)::BIGINT END AS visible_rows
  FROM g LEFT JOIN (SELECT subject_id, count(*) AS n FROM plc GROUP BY 1) p ON p.subject_id = g.subject_id
  GROUP BY 1"""))
def b6_granted_rows_per_viewer(spark, sf):
    grants = scope.resolve_grants(view(spark, sf, "grants"), "viewer", "subject")
    return scope.granted_counts(view(spark, sf, "readings"), F.col("uploader_phone_id"), grants, "viewer")


@query(sql("grants readings", GRANTED + PLC + """
  SELECT v.viewer, p.subject_id, count(*) AS n FROM (SELECT DISTINCT viewer FROM grants) v
  JOIN plc p ON EXISTS (SELECT 1 FROM g WHERE g.viewer = v.viewer AND g.subject_id IN ('*', p.subject_id)) GROUP BY 1, 2"""))
def b5_scope_by_grants(spark, sf):
    grants = scope.resolve_grants(view(spark, sf, "grants"), "viewer", "subject")
    readings = view(spark, sf, "readings").select(values.subject_of(F.col("uploader_phone_id")).alias("subject_id"))
    out = None
    for viewer in sorted(r.viewer for r in view(spark, sf, "grants").select("viewer").distinct().collect()):
        seen = scope.restrict(readings, F.col("subject_id"), scope.scope_of(grants, "viewer", viewer))
        one = seen.groupBy("subject_id").agg(F.count("*").alias("n")).withColumn("viewer", F.lit(viewer))
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("sessions uploads", ATT + " SELECT id AS session_id FROM att WHERE subject_id IN ('p01', 'p02')"))
def b7_scoped_session_ids(spark, sf):
    return scope.scoped_session_ids(attributed(spark, sf), ["p01", "p02"])


@query(sql("minutes", " SELECT subject_id, count(*) AS n FROM minutes WHERE subject_id = 'p04' GROUP BY 1"))
def b8_unattributed_hidden(spark, sf):
    minutes = view(spark, sf, "minutes")
    hidden = scope.hide_unattributed(minutes.drop("subject_id").withColumn("s", F.lit("p04")), ["p04"], "subject_id")
    shown = scope.hide_unattributed(minutes, ["p04"])
    both = shown.select("subject_id").unionByName(hidden.select(F.col("s").alias("subject_id")))
    return both.groupBy("subject_id").agg(F.count("*").alias("n"))


@query(sql("readings", PLC + f" SELECT count(*) AS n, min(wall_epoch) AS oldest FROM plc WHERE wall_epoch >= {NOW} - 10 * 86400"))
def b9_look_back(spark, sf):
    kept = placed(spark, sf).where(clock.since_days(F.col("wall_epoch"), NOW, 10))
    return kept.agg(F.count("*").alias("n"), F.min("wall_epoch").alias("oldest"))


@query(sql("readings", " SELECT reading_id FROM readings WHERE coalesce(clock_suspect, FALSE) = FALSE"))
def b10_not_quarantined(spark, sf):
    return view(spark, sf, "readings").where(clock.not_quarantined(F.col("clock_suspect"))).select("reading_id")


@query(sql("minutes", " SELECT label, CASE WHEN isnan(sqi) THEN NULL ELSE round_even(sqi, 1) END AS sqi, round_even(hr_ppg, 0) AS hr FROM minutes"))
def b11_finite_rounded(spark, sf):
    return view(spark, sf, "minutes").select(
        "label", values.finite(F.col("sqi"), 1).alias("sqi"), values.finite(F.col("hr_ppg"), 0).alias("hr")
    )


@query(sql("sessions", " SELECT id, round(coalesce(end_time, start_time) - start_time, 6) AS span_s, round(CASE WHEN end_time <> 0 AND start_time <> 0 THEN end_time - start_time END, 6) AS closed_s FROM sessions"))
def b12_duration(spark, sf):
    start, end = F.col("start_time"), F.col("end_time")
    return view(spark, sf, "sessions").select(
        "id",
        F.round(clock.span_s(start, end), 6).alias("span_s"),
        F.round(clock.closed_span_s(start, end), 6).alias("closed_s"),
    )


@query(sql("uploads", " SELECT phone_session_uuid, round(CASE WHEN completed_at IS NOT NULL THEN greatest(0, 1706000000.0 - completed_at) END, 6) AS age_s FROM uploads"))
def b13_age(spark, sf):
    return view(spark, sf, "uploads").select(
        "phone_session_uuid", F.round(clock.age_s(F.col("completed_at"), 1706000000.0), 6).alias("age_s")
    )


NOTE = """, nf AS (
  SELECT session_id, ts, json_extract_string(note, '$.event') AS event, json_extract_string(note, '$.name') AS name,
         CAST(json_extract(note, '$.tags') AS VARCHAR) AS tags
  FROM (SELECT session_id, ts, CASE WHEN json_valid(note) THEN note END AS note FROM notes))"""


@query(sql("notes", NOTE + " SELECT * FROM nf WHERE event IN ('calibration_start', 'calibration_stop')"))
def b14_event_markers(spark, sf):
    return c.markers(view(spark, sf, "notes"))


@query(sql("notes", " SELECT count(*) FILTER (WHERE NOT json_valid(note)) AS malformed_notes, count(*) AS notes FROM notes"))
def b14_malformed_notes(spark, sf):
    return c.malformed_notes(view(spark, sf, "notes"))


RVIEW = """SELECT reading_id, taken_at, sys, dia, pulse, coalesce(nullif(uploader_phone_id, ''), 'unknown') AS subject_id,
  clock_offset_s, coalesce(clock_valid, FALSE) AS clock_valid, coalesce(clock_suspect, FALSE) AS clock_suspect,
  coalesce(ihb, FALSE) AS irregular, coalesce(mov, FALSE) AS movement FROM readings"""


@query(sql("readings", " " + RVIEW))
def b15_reading_flags(spark, sf):
    return c.reading_view(view(spark, sf, "readings"))


@query(sql("readings minutes", """ SELECT 'low' AS flag, count(*) AS n FROM readings WHERE sys < 90
  UNION ALL SELECT 'usable', count(*) FROM minutes WHERE sqi >= 0.8 AND NOT isnan(sqi)
  UNION ALL SELECT 'usable_with_nan', count(*) FROM minutes WHERE sqi > 0.8"""))
def b16_threshold_flags(spark, sf):
    minutes, sqi = view(spark, sf, "minutes"), F.col("sqi")
    flags = {
        "low": view(spark, sf, "readings").where(values.below(F.col("sys"), 90)),
        "usable": minutes.where(values.usable(sqi, inclusive=True)),
        "usable_with_nan": minutes.where(values.usable(sqi, nan_is_good=True)),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("flag"), "n") for name, df in flags.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(sql("sessions", " SELECT id, substr(session_uuid, 1, 8) AS uuid FROM sessions"))
def b17_short_id(spark, sf):
    return view(spark, sf, "sessions").select("id", values.short_id(F.col("session_uuid")).alias("uuid"))


# ---- joins

@query(sql("sessions uploads", ATT + " SELECT id, subject_id, upload_status FROM att"))
def c1_recording_owner(spark, sf):
    return attributed(spark, sf).select("id", "subject_id", "upload_status")


@query(sql("sessions uploads readings", ATT + PLC + GAP + " SELECT reading_id, subject_id, round(gap, 6) AS gap, matched_id FROM gaps"))
def c2_nearest_interval(spark, sf):
    gaps = c.reading_gaps(placed(spark, sf), attributed(spark, sf))
    return gaps.select("reading_id", "subject_id", F.round("gap", 6).alias("gap"), "matched_id")


@query(sql("sessions uploads notes", ATT + """ SELECT a.id, a.subject_id, coalesce(n, 0) AS notes FROM att a
  LEFT JOIN (SELECT session_id, count(*) AS n FROM notes GROUP BY 1) x ON x.session_id = a.id"""))
def c5_notes_per_session(spark, sf):
    return c.notes_per_session(attributed(spark, sf), view(spark, sf, "notes")).select("id", "subject_id", "notes")


@query(sql("sessions uploads readings", ALL_STATE + " SELECT subject_id, sessions, cuff_readings, pairs FROM stt"))
def c7_merged_subjects(spark, sf):
    return state(spark, sf).select("subject_id", "sessions", "cuff_readings", "pairs")


@query(sql("sessions uploads notes", ATT + """ SELECT count(*) AS notes FROM notes
  WHERE session_id IN (SELECT id FROM att WHERE subject_id IN ('p01', 'p02', 'unknown'))"""))
def c9_scoped_child_rows(spark, sf):
    kept = scope.within_sessions(view(spark, sf, "notes"), attributed(spark, sf), ["p01", "p02", "unknown"])
    return kept.agg(F.count("*").alias("notes"))


# ---- aggregates

@query(sql("sessions uploads readings", ATT + PLC + RBS + " SELECT subject_id, sessions, round(recorded_hours, 4) AS recorded_hours, last_session_at FROM rec"))
def d1_recordings_by_subject(spark, sf):
    return rounded(c.recordings_by_subject(attributed(spark, sf)), 4, "recorded_hours")


@query(sql("sessions uploads readings", ATT + PLC + RBS + " SELECT * FROM red"))
def d2_readings_by_subject(spark, sf):
    return c.readings_by_subject(placed(spark, sf))


@query(sql("sessions uploads readings", ATT + PLC + RBS + " SELECT subject_id, cuff_per_day, round(cuff_rate_span_days, 6) AS cuff_rate_span_days FROM rate"))
def d3_observed_rate(spark, sf):
    rate = c.observed_rate(c.readings_by_subject(placed(spark, sf)))
    return rounded(rate.select("subject_id", "cuff_per_day", "cuff_rate_span_days"), 6, "cuff_rate_span_days")


@query(sql("sessions uploads readings", ALL_STATE + " SELECT subject_id, last_cuff_transfer_age_s, estimated_unsynced_cuff FROM stt"))
def d4_unsynced_projection(spark, sf):
    return state(spark, sf).select("subject_id", "last_cuff_transfer_age_s", "estimated_unsynced_cuff")


@query(sql("sessions uploads readings", ATT + PLC + GAP + OUT + " SELECT * REPLACE (round(nearest_miss_s, 6) AS nearest_miss_s) FROM outc"))
def d5_pair_outcomes(spark, sf):
    gaps = c.reading_gaps(placed(spark, sf), attributed(spark, sf))
    return rounded(c.pair_outcomes(c.reading_outcomes(gaps)), 6, "nearest_miss_s")


CLK = """, clk AS (SELECT count(*) AS cuff_total, count(clock_offset_s) AS with_provenance,
  count(*) FILTER (WHERE clock_offset_s IS NOT NULL AND NOT coalesce(clock_valid, FALSE)) AS not_valid,
  count(*) FILTER (WHERE clock_offset_s IS NULL) AS no_provenance,
  count(*) FILTER (WHERE coalesce(clock_suspect, FALSE)) AS suspect,
  max(abs(clock_offset_s)) AS max_abs_offset_s FROM readings)"""


@query(sql("readings", CLK + " SELECT * FROM clk"))
def d6_clock_provenance(spark, sf):
    return c.clock_provenance(view(spark, sf, "readings"))


QLT = """, qlt AS (SELECT count(*) AS minutes, count(*) FILTER (WHERE sqi > 0.8 AND NOT isnan(sqi)) AS good_minutes FROM minutes)"""


@query(sql("minutes", QLT + " SELECT * FROM qlt"))
def d7_usable_minutes(spark, sf):
    return c.usable_minutes(view(spark, sf, "minutes"))


@query(sql("uploads", " SELECT status, count(*) AS uploads FROM uploads GROUP BY 1"))
def d8_uploads_by_status(spark, sf):
    return c.uploads_by_status(view(spark, sf, "uploads"))


BLG = f""", inc AS (SELECT opened_at FROM uploads WHERE coalesce(status, '') <> 'complete'),
blg AS (SELECT count(*) - count(*) FILTER (WHERE opened_at < {NOW} - 129600) AS count,
  {NOW} - min(opened_at) FILTER (WHERE opened_at >= {NOW} - 129600) AS oldest_age_s,
  count(*) FILTER (WHERE opened_at >= {NOW} - 900) AS in_flight,
  count(*) FILTER (WHERE opened_at < {NOW} - 129600) AS abandoned, count(*) AS total_incomplete,
  {NOW} - min(opened_at) AS oldest_incomplete_age_s FROM inc)"""


@query(sql("uploads", BLG + " SELECT * FROM blg"))
def d9_upload_backlog(spark, sf):
    return c.upload_backlog(view(spark, sf, "uploads"), NOW)


@query(sql("sessions uploads notes readings ppg motion", ATT + """,
 ids AS (SELECT id FROM att WHERE subject_id IN ('p01', 'p05'))
 SELECT 'sessions' AS table_name, count(*) AS row_count FROM ids
 UNION ALL SELECT 'ppg', count(*) FROM ppg WHERE session_id IN (SELECT id FROM ids)
 UNION ALL SELECT 'acc', count(*) FROM motion WHERE sensor = 'acc' AND session_id IN (SELECT id FROM ids)
 UNION ALL SELECT 'gyro', count(*) FROM motion WHERE sensor = 'gyro' AND session_id IN (SELECT id FROM ids)
 UNION ALL SELECT 'notes', count(*) FROM notes WHERE session_id IN (SELECT id FROM ids)
 UNION ALL SELECT 'cuff_readings', count(*) FROM readings WHERE uploader_phone_id IN ('p01', 'p05')"""))
def d10_table_totals(spark, sf):
    return c.table_totals(store(spark, sf), attributed(spark, sf), ["p01", "p05"])


@query(sql("sessions uploads held_samples", ATT + """, ids AS (SELECT id FROM att WHERE subject_id IN ('p01', 'p05'))
 SELECT 'sessions' AS table_name, count(*) AS row_count FROM ids
 UNION ALL SELECT sensor, count(*) FROM held_samples WHERE session_id IN (SELECT id FROM ids) GROUP BY 1"""))
def d10_sample_totals(spark, sf):
    """Samples that lie in recordings, of each sensor."""
    held = view(spark, sf, "held_samples")
    tables = store(spark, sf) | {s: held.where(F.col("sensor") == s).drop("sensor") for s in ("ppg", "acc", "gyro")}
    found = c.table_totals(tables, attributed(spark, sf), ["p01", "p05"])
    return found.where(F.col("table_name").isin("sessions", "ppg", "acc", "gyro"))


@query(sql("uploads readings", """ SELECT 'last_ingest_at' AS what, strftime(make_timestamp(CAST(round(max(completed_at) * 1e6) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS at FROM uploads
 UNION ALL SELECT 'last_cuff_sync_at', strftime(make_timestamp(CAST(round(max(uploaded_at) * 1e6) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%f+00:00') FROM readings"""))
def d17_last_activity(spark, sf):
    return c.last_activity(view(spark, sf, "uploads"), view(spark, sf, "readings"))


@query(sql("uploads", """ SELECT phone_session_uuid, CASE WHEN coalesce(convert_stats_json, '') = '' THEN 0
   WHEN json_valid(convert_stats_json) THEN CAST(json_extract(convert_stats_json, '$.samples_per_sensor.acc') AS BIGINT)
     + CAST(json_extract(convert_stats_json, '$.samples_per_sensor.ppg') AS BIGINT) END AS samples FROM
   (SELECT phone_session_uuid, convert_stats_json FROM uploads)"""))
def d18_upload_samples(spark, sf):
    return c.upload_samples(view(spark, sf, "uploads")).select("phone_session_uuid", "samples")


@query(sql("readings", PLC + " SELECT DISTINCT subject_id FROM plc"))
def d20_subjects_with_readings(spark, sf):
    return c.subjects_with_readings(view(spark, sf, "readings"))


# ---- sorts and limits

F1 = """, f1 AS (SELECT id, substr(session_uuid, 1, 8) AS uuid, start_time, end_time - start_time AS duration_s,
  device_name, subject_id, upload_status AS status, (SELECT count(*) FROM notes n WHERE n.session_id = a.id) AS notes
  FROM att a ORDER BY start_time DESC, id LIMIT 15)"""


@query(sql("sessions uploads notes", ATT + F1 + " SELECT * REPLACE (round(duration_s, 6) AS duration_s) FROM f1"))
def f1_recent_sessions(spark, sf):
    return rounded(c.recent_sessions(attributed(spark, sf), view(spark, sf, "notes")), 6, "duration_s")


@query(sql("readings", f" {RVIEW} ORDER BY taken_at DESC, reading_id LIMIT 15"))
def f2_recent_readings(spark, sf):
    return c.recent_readings(view(spark, sf, "readings"))


@query(sql("notes", NOTE + " SELECT * FROM nf WHERE event IN ('calibration_start', 'calibration_stop') ORDER BY ts DESC, session_id LIMIT 20"))
def f3_recent_markers(spark, sf):
    return c.recent_markers(view(spark, sf, "notes"))


@query(sql("uploads", " SELECT phone_session_uuid, opened_at, status FROM uploads ORDER BY opened_at DESC NULLS LAST, phone_session_uuid LIMIT 100"))
def f4_newest_uploads(spark, sf):
    return c.newest_uploads(view(spark, sf, "uploads")).select("phone_session_uuid", "opened_at", "status")


# ---- rules: the counterparts spell each rule out again

def _g(x: str) -> str:
    """Six significant digits in SQL, for the magnitudes the views reach."""
    return f"regexp_replace(printf('%.2f', {x}), '\\.?0+$', '')"


def _dh(x: str) -> str:
    return (
        f"CASE WHEN {x} < 86400 THEN CAST(CAST(round_even({x} / 3600, 0) AS BIGINT) AS VARCHAR) || ' h' "
        f"ELSE CAST(CAST(round_even({x} / 86400, 0) AS BIGINT) AS VARCHAR) || ' d' END"
    )


BASIS = f"CASE WHEN cuff_per_day IS NOT NULL AND cuff_rate_span_days IS NOT NULL THEN ' Projected from ' || {_g('cuff_per_day')} || '/day observed over ' || {_g('cuff_rate_span_days')} || ' d.' ELSE '' END"
WHY = f"""CASE WHEN cuff_readings = 0 THEN '{rules.WHY_NO_READINGS}' WHEN sessions = 0 THEN '{rules.WHY_NO_RECORDINGS}'
  WHEN unpaired_clock_never_read > 0 AND unpaired_clock_never_read >= unpaired_no_overlap
    THEN printf('{rules.WHY_NEVER_READ.replace('%s', '%d')}', unpaired_clock_never_read)
  WHEN unpaired_clock_invalid + unpaired_clock_suspect > 0 AND unpaired_clock_invalid + unpaired_clock_suspect >= unpaired_no_overlap
    THEN printf('{rules.WHY_BAD_CLOCK.replace('%s', '%d')}', unpaired_clock_invalid + unpaired_clock_suspect)
  WHEN unpaired_no_overlap = 0 THEN '{rules.WHY_NONE_INSIDE}'
  WHEN nearest_miss_s IS NULL THEN printf('{rules.WHY_OUTSIDE.replace('%s', '%d')}.', unpaired_no_overlap)
  WHEN nearest_miss_s >= 3540 AND abs(nearest_miss_s - round_even(nearest_miss_s / 3600, 0) * 3600) < 120
    THEN printf('{(rules.WHY_OUTSIDE + rules.WHY_ZONE).replace('%s', '%d')}', unpaired_no_overlap, CAST(round_even(nearest_miss_s / 3600, 0) AS BIGINT))
  WHEN nearest_miss_s < 1800 THEN printf('{(rules.WHY_OUTSIDE + rules.WHY_CLOSE).replace('%s', '%d')}', unpaired_no_overlap, CAST(round_even(nearest_miss_s / 60, 0) AS BIGINT))
  ELSE printf('{rules.WHY_OUTSIDE.replace('%s', '%d')}', unpaired_no_overlap) || ', the closest by ' || CASE WHEN nearest_miss_s >= 86400 THEN {_dh('nearest_miss_s')}
    ELSE printf('%.1f h', round_even(nearest_miss_s / 3600, 1)) END || '. Record and measure at the same time.' END"""
SUBJECT_RULES = {
    1: ("warn", "last_session_age_s IS NULL", f"'{rules.NO_RECORDINGS}'", "''"),
    2: ("error", "last_session_age_s > 172800", f"'No recording for ' || {_dh('last_session_age_s')}", f"'{rules.COLLECTION_STOPPED}'"),
    3: ("error", "last_cuff_transfer_age_s > 1209600", f"'Cuff not transferred for ' || {_dh('last_cuff_transfer_age_s')}", f"'{rules.OVERWRITES}'"),
    4: ("error", "estimated_unsynced_cuff >= 100", f"'{rules.BUFFER_FULL}'", f"replace('{rules.BUFFER_FULL_WHY.replace('%s', '@', 1).replace('%s', '')}', '@', {_g('estimated_unsynced_cuff')}) || {BASIS}"),
    5: ("warn", "estimated_unsynced_cuff >= 70 AND estimated_unsynced_cuff < 100", f"'{rules.BUFFER_FILLING}'", f"replace('{rules.BUFFER_FILLING_WHY.replace('%s', '@', 1).replace('%s', '')}', '@', {_g('estimated_unsynced_cuff')}) || {BASIS}"),
    6: ("warn", "pairs = 0", f"'{rules.NO_PAIRS}'", WHY),
    7: ("info", "pairs > 0 AND pairs < 20", "printf('%d of 20 calibration pairs', pairs)", f"'{rules.PAIRS_WANTED}'"),
}


def _rules(source: str, subject: str, table: dict) -> str:
    rank = {"error": 0, "warn": 1, "info": 2}
    return " UNION ALL ".join(
        f"SELECT {subject} AS subject_id, {n} AS rule, '{level}' AS level, {rank[level]} AS rank, {message} AS message, {detail} AS detail FROM {source} WHERE {when}"
        for n, (level, when, message, detail) in table.items()
    )


def _count(template: str, column: str) -> str:
    return f"CAST({column} AS VARCHAR) || '{template.replace('%s', '').replace(chr(39), chr(39) * 2)}'"


def _q(words: str) -> str:
    return "'" + words.replace("'", "''") + "'"


CLOCK_RULES = {
    8: ("error", "not_valid > 0", _count(rules.BAD_CLOCKS, "not_valid"), _q(rules.BAD_CLOCKS_WHY)),
    9: ("info", "no_provenance > 0", _count(rules.OLD_CLOCKS, "no_provenance"), _q(rules.OLD_CLOCKS_WHY)),
    10: ("warn", "suspect > 0", _count(rules.QUARANTINED, "suspect"), "''"),
}
BACKLOG_RULES = {
    11: ("error", "count - in_flight > 0", _count(rules.STALLED, "(count - in_flight)"), _q(rules.STALLED_WHY)),
    12: ("info", "count - in_flight <= 0 AND in_flight > 0", f"CASE WHEN in_flight = 1 THEN {_count(rules.ONE_IN_FLIGHT, 'in_flight')} ELSE {_count(rules.IN_FLIGHT, 'in_flight')} END", _q(rules.IN_FLIGHT_WHY)),
    13: ("warn", "abandoned > 0", f"CASE WHEN abandoned = 1 THEN {_count(rules.ONE_ABANDONED, 'abandoned')} ELSE {_count(rules.ABANDONED, 'abandoned')} END", _q(rules.ABANDONED_WHY)),
}
QUALITY_RULES = {
    14: ("warn", "minutes > 0 AND good_minutes / minutes < 0.7", "'Only ' || CAST(CAST(round_even(good_minutes / minutes * 100, 0) AS BIGINT) AS VARCHAR) || '% of PPG minutes are usable'", _q(rules.LOW_SHARE_WHY)),
}
SUBJECT_RULES_SQL = _rules("stt", "subject_id", SUBJECT_RULES)
STORE_RULES_SQL = " UNION ALL ".join(
    [_rules("clk", "NULL::VARCHAR", CLOCK_RULES), _rules("blg", "NULL::VARCHAR", BACKLOG_RULES), _rules("qlt", "NULL::VARCHAR", QUALITY_RULES)]
)


def _subject_rule(*numbers: int):
    def run(spark, sf):
        return rules.subject_warnings(state(spark, sf, LATER)).where(F.col("rule").isin(*numbers))

    return run


def _register_rules() -> None:
    for name, numbers in {
        "r1_recording_age": (1, 2),
        "r2_transfer_age": (3,),
        "r3_buffer_projection": (4, 5),
        "r4_pair_count": (6, 7),
    }.items():
        QUERIES[name] = _subject_rule(*numbers)
        picked = {n: SUBJECT_RULES[n] for n in numbers}
        ORACLE[name] = sql("sessions uploads readings", ALL_STATE.replace(str(NOW), str(LATER)) + " " + _rules("stt", "subject_id", picked))


_register_rules()


@query(sql("readings", CLK + " " + _rules("clk", "NULL::VARCHAR", CLOCK_RULES)))
def r5_clock_rules(spark, sf):
    return rules.clock_warnings(c.clock_provenance(view(spark, sf, "readings")))


@query(sql("uploads", BLG + " " + _rules("blg", "NULL::VARCHAR", {n: BACKLOG_RULES[n] for n in (11, 12)})))
def r6_stalled_uploads(spark, sf):
    return rules.backlog_warnings(c.upload_backlog(view(spark, sf, "uploads"), NOW)).where("rule < 13")


@query(sql("uploads", BLG + " " + _rules("blg", "NULL::VARCHAR", {13: BACKLOG_RULES[13]})))
def r7_abandoned_uploads(spark, sf):
    return rules.backlog_warnings(c.upload_backlog(view(spark, sf, "uploads"), NOW)).where("rule = 13")


@query(sql("minutes", QLT + " " + _rules("qlt", "NULL::VARCHAR", QUALITY_RULES)))
def r8_usable_share(spark, sf):
    return rules.quality_warnings(c.usable_minutes(view(spark, sf, "minutes")))


@query(sql("sessions uploads readings", ALL_STATE + f" SELECT subject_id, {WHY} AS why FROM stt"))
def r9_why_no_pairs(spark, sf):
    return state(spark, sf).select("subject_id", rules.why_no_pairs().alias("why"))


def _age(x: str) -> str:
    n = lambda e: f"CAST(CAST(floor({e} + 0.5) AS BIGINT) AS VARCHAR)"
    return (
        f"CASE WHEN {x} IS NULL THEN 'never' WHEN {x} < 90 THEN {n(x)} || ' s ago' "
        f"WHEN {x} / 60 < 90 THEN {n(x + ' / 60')} || ' min ago' WHEN {x} / 3600 < 48 THEN {n(x + ' / 3600')} || ' h ago' "
        f"ELSE {n(x + ' / 86400')} || ' d ago' END"
    )


UNPAIRED = """CASE WHEN unpaired_no_overlap + unpaired_clock_never_read + unpaired_clock_invalid + unpaired_clock_suspect = 0 THEN '' ELSE
 'Unpaired: ' || concat_ws(', ',
   CASE WHEN unpaired_no_overlap > 0 THEN CAST(unpaired_no_overlap AS VARCHAR) || ' outside a recording' END,
   CASE WHEN unpaired_clock_never_read > 0 THEN CAST(unpaired_clock_never_read AS VARCHAR) || ' with no cuff clock' END,
   CASE WHEN unpaired_clock_invalid > 0 THEN CAST(unpaired_clock_invalid AS VARCHAR) || ' clock rejected' END,
   CASE WHEN unpaired_clock_suspect > 0 THEN CAST(unpaired_clock_suspect AS VARCHAR) || ' clock suspect' END) || '.'
 || CASE WHEN nearest_miss_s IS NULL THEN '' WHEN nearest_miss_s < 5400
      THEN ' Closest miss ' || CAST(CAST(floor(nearest_miss_s / 60 + 0.5) AS BIGINT) AS VARCHAR) || ' min.'
      ELSE ' Closest miss ' || printf('%.1f h.', round(nearest_miss_s / 3600, 1)) END END"""


@query(sql("sessions uploads readings", ALL_STATE + """ SELECT subject_id,
  CASE WHEN last_session_age_s IS NULL THEN 'warn' WHEN last_session_age_s > 172800 THEN 'error' ELSE 'ok' END AS recording_state,
  CASE WHEN last_cuff_transfer_age_s IS NULL THEN 'warn' WHEN last_cuff_transfer_age_s > 1209600 THEN 'error' ELSE 'ok' END AS transfer_state,
  CASE WHEN estimated_unsynced_cuff IS NULL THEN '' WHEN estimated_unsynced_cuff >= 100 THEN 'error'
       WHEN estimated_unsynced_cuff >= 70 THEN 'warn' ELSE 'ok' END AS buffer_state,
  CASE WHEN pairs = 0 THEN 'warn' WHEN pairs < 20 THEN '' ELSE 'ok' END AS pairs_state FROM stt"""))
def r10_tile_states(spark, sf):
    return rules.tile_states(state(spark, sf)).select(
        "subject_id", "recording_state", "transfer_state", "buffer_state", "pairs_state"
    )


@query(sql("sessions uploads readings", ALL_STATE + f""" SELECT subject_id, {_age('last_session_age_s')} AS recording_text,
  {_age('last_cuff_transfer_age_s')} AS transfer_text, {UNPAIRED} AS unpaired_text FROM stt"""))
def r11_people_texts(spark, sf):
    return rules.tile_states(state(spark, sf)).select("subject_id", "recording_text", "transfer_text", "unpaired_text")


@query(sql("sessions uploads readings minutes", ALL_STATE + CLK + BLG + QLT + f""" , w AS ({SUBJECT_RULES_SQL} UNION ALL {STORE_RULES_SQL})
  SELECT * FROM w"""))
def f6_ranked_warnings(spark, sf):
    found = rules.all_warnings(
        state(spark, sf),
        c.clock_provenance(view(spark, sf, "readings")),
        c.upload_backlog(view(spark, sf, "uploads"), NOW),
        c.usable_minutes(view(spark, sf, "minutes")),
    )
    return rules.ranked(found)


YOUNG = f"opened_at >= {NOW} - 900"


@query(sql("sessions uploads readings minutes", ALL_STATE.replace(str(NOW), str(LATER)) + CLK + f", young AS (SELECT * FROM uploads WHERE {YOUNG})"
  + BLG.replace("FROM uploads", "FROM young") + QLT + f""" , w AS ({SUBJECT_RULES_SQL} UNION ALL {STORE_RULES_SQL}) SELECT * FROM w"""))
def f6_ranked_warnings_later(spark, sf):
    """A store not fed for 25 days, with uploads in flight only: the age, buffer and in-flight rules fire."""
    found = rules.all_warnings(
        state(spark, sf, LATER),
        c.clock_provenance(view(spark, sf, "readings")),
        c.upload_backlog(view(spark, sf, "uploads").where(YOUNG), NOW),
        c.usable_minutes(view(spark, sf, "minutes")),
    )
    return rules.ranked(found)


@query(sql("sessions uploads readings", ALL_STATE + " SELECT * REPLACE (round(nearest_miss_s, 6) AS nearest_miss_s) FROM stt ORDER BY subject_id"))
def f7_subject_state_sorted(spark, sf):
    return rounded(state(spark, sf), 6, "nearest_miss_s").orderBy("subject_id")


