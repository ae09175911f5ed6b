"""Series over time: points, coverage, quality, daily and hourly summaries, runs, pairs."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql.functions import asc, desc

from catalog.collection import ATT, GAP, HELD, PLC, attributed, placed, rounded
from catalog.views import NOW, TZ, sql, view
from wavecohort.operators import intervals, scope, trends
from wavecohort.operators.ordered import top_per_group
from wavecohort.plans.series import Series
from wavecohort.session import intermediate
from wavecohort.sources import days

QUERIES = {}
ORACLE = {}


def query(counterpart: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if counterpart is not None:
            ORACLE[fn.__name__] = counterpart
        return fn

    return keep


LOCAL_TS = f"timezone('{TZ}', timezone('UTC', make_timestamp(CAST(round(ts * 1e6) AS BIGINT))))"
PTS = """, ranked AS (SELECT reading_id, t AS ts, sys, dia, pulse, subject_id, coalesce(clock_valid, FALSE) AS clock_ok,
    coalesce(ihb, FALSE) AS irregular, row_number() OVER (PARTITION BY subject_id ORDER BY t DESC, reading_id DESC) AS rn
  FROM plc WHERE NOT coalesce(clock_suspect, FALSE)), pts AS (SELECT * EXCLUDE (rn) FROM ranked)"""
COV = f""", sday AS (SELECT strftime(timezone('{TZ}', timezone('UTC', make_timestamp(CAST(round(start_time * 1e6) AS BIGINT)))), '%Y-%m-%d') AS day,
    subject_id, sum(coalesce(end_time, start_time) - start_time) / 60 AS minutes, count(*) AS sessions
  FROM att GROUP BY 1, 2),
rday AS (SELECT substr(taken_at, 1, 10) AS day, subject_id, count(*) AS n FROM plc GROUP BY 1, 2),
cov AS (SELECT day, subject_id, coalesce(round_even(minutes, 1), 0) AS recorded_minutes, coalesce(sessions, 0) AS sessions,
  coalesce(n, 0) AS cuff_count FROM sday FULL JOIN rday USING (day, subject_id))"""


def points(spark, sf):
    return trends.reading_points(placed(spark, sf), NOW)


def coverage(spark, sf):
    return trends.coverage_days(
        trends.recorded_by_day(attributed(spark, sf), TZ, NOW),
        trends.readings_by_day(placed(spark, sf), NOW),
    )


@query(sql("sessions uploads readings", ATT + PLC + GAP + HELD + " SELECT reading_id, session_id FROM held"))
def c3_containing_interval(spark, sf):
    who = placed(spark, sf).select("reading_id", "subject_id", "t")
    inside = intervals.containing_interval(
        who, attributed(spark, sf), "subject_id", "t", "start_time", "end_time", "id"
    )
    return inside.select("reading_id", "session_id")


BAND = """, band AS (SELECT p.reading_id, avg(m.hr_ppg) AS hr_ppg, avg(m.sqi) AS sqi FROM plc p LEFT JOIN minutes m
  ON {key} abs(m.ts - p.t) <= 90 GROUP BY 1)"""


def _bands(spark, sf, keys, minutes="minutes"):
    who = placed(spark, sf).select("reading_id", "subject_id", "t")
    near = intervals.band_average(
        who, view(spark, sf, minutes), keys, "reading_id", "t", "ts", ["hr_ppg", "sqi"]
    )
    return rounded(near.select("reading_id", "hr_ppg", "sqi"), 5, "hr_ppg", "sqi")


@query(sql("readings minutes", PLC + BAND.format(key="") + " SELECT reading_id, round(hr_ppg, 5) AS hr_ppg, round(sqi, 5) AS sqi FROM band"))
def c4_band_average_all_subjects(spark, sf):
    return _bands(spark, sf, [])


@query(sql("readings minutes", PLC + BAND.format(key="m.subject_id = p.subject_id AND") + " SELECT reading_id, round(hr_ppg, 5) AS hr_ppg, round(sqi, 5) AS sqi FROM band"))
def c4_band_average_by_subject(spark, sf):
    return _bands(spark, sf, ["subject_id"])


NEAR = ", minutes AS (SELECT * FROM minutes_near)"


@query(sql("readings minutes_near", NEAR + PLC + BAND.format(key="m.subject_id = p.subject_id AND") + " SELECT reading_id, round(hr_ppg, 5) AS hr_ppg, round(sqi, 5) AS sqi FROM band"))
def c4_band_average_near(spark, sf):
    """By subject, with minutes around most readings."""
    return _bands(spark, sf, ["subject_id"], "minutes_near")


@query(sql("sessions uploads readings grants", ATT + PLC + f""", sc AS (SELECT subject FROM grants WHERE viewer = 'EUROPE' AND trim(subject) <> ''),
 att2 AS (SELECT * FROM att WHERE start_time >= {NOW} - 14 * 86400 AND subject_id IN (FROM sc)),
 plc2 AS (SELECT * FROM plc WHERE wall_epoch >= {NOW} - 14 * 86400 AND subject_id IN (FROM sc))"""
  + COV.replace("FROM att ", "FROM att2 ").replace("FROM plc ", "FROM plc2 ") + " SELECT * FROM cov"))
def d11_scoped_days(spark, sf):
    """Two weeks of one viewer's subjects, from tables in folders of day and subject part."""
    paths = {n: intermediate(spark, n) for n in ("readings", "sessions")}
    readings, owned = view(spark, sf, "readings"), attributed(spark, sf)
    days.write_days(readings, paths["readings"], F.substring("taken_at", 1, 10), F.col("uploader_phone_id"), parts=4)
    days.write_days(owned, paths["sessions"], days.day_of(F.col("start_time")), F.col("subject_id"), parts=4)
    grants = intermediate(spark, "grants")
    scope.resolve_grants(view(spark, sf, "grants"), "viewer", "subject").write.parquet(grants)
    seen, since = scope.scope_of(spark.read.parquet(grants), "viewer", "EUROPE"), days.first_day(NOW, 14)
    tables = {
        "cuff_readings": days.read_days(spark, paths["readings"], readings.schema, "uploader_phone_id", since, seen, parts=4),
        "sessions": days.read_days(spark, paths["sessions"], owned.schema, "subject_id", since, seen, parts=4).drop("subject_id"),
        "uploads": view(spark, sf, "uploads"),
    }
    return Series(tables, NOW, TZ, 14, seen).coverage


@query(sql("sessions uploads readings", ATT + PLC + COV + " SELECT * FROM cov"))
def c6_coverage_merge(spark, sf):
    return coverage(spark, sf)


@query(sql("sessions uploads readings", ATT + PLC + COV + """,
  grid AS (SELECT subject_id, strftime(d, '%Y-%m-%d') AS day FROM (SELECT DISTINCT subject_id FROM cov),
           generate_series(DATE '2023-12-25', DATE '2024-01-31', INTERVAL 1 DAY) g(d))
  SELECT day, subject_id, coalesce(recorded_minutes, 0) AS recorded_minutes, coalesce(sessions, 0) AS sessions,
         coalesce(cuff_count, 0) AS cuff_count FROM grid LEFT JOIN cov USING (day, subject_id)"""))
def c8_calendar(spark, sf):
    return trends.calendar(coverage(spark, sf), "2023-12-25", "2024-01-31")


PAIRS = """, tp AS (SELECT * FROM plc WHERE coalesce(clock_valid, FALSE) AND NOT coalesce(clock_suspect, FALSE) {offset}),
pr AS (SELECT p.reading_id, p.t AS ts, p.sys, p.dia, p.pulse, p.subject_id, g.session_id,
   (SELECT avg(m.hr_ppg) FROM minutes m WHERE {key} abs(m.ts - p.t) <= 90) AS hr_ppg,
   (SELECT avg(m.sqi) FROM minutes m WHERE {key} abs(m.ts - p.t) <= 90) AS sqi
 FROM tp p JOIN held g USING (reading_id)),
prs AS (SELECT * REPLACE (CASE WHEN isfinite(hr_ppg) THEN round_even(hr_ppg, 1) END AS hr_ppg,
                          CASE WHEN isfinite(sqi) THEN round_even(sqi, 3) END AS sqi) FROM pr)"""
BY_REF = PAIRS.format(offset="", key="")
BY_SUBJECT = PAIRS.format(offset="AND clock_offset_s IS NOT NULL", key="m.subject_id = p.subject_id AND")


@query(sql("sessions uploads readings minutes", ATT + PLC + GAP + HELD + BY_SUBJECT + " SELECT * REPLACE (round(ts, 6) AS ts) FROM prs"))
def p2_pair_points(spark, sf):
    found = trends.pair_points(placed(spark, sf), attributed(spark, sf), view(spark, sf, "minutes"))
    return rounded(found, 6, "ts")


@query(sql("sessions uploads readings minutes_near", NEAR + ATT + PLC + GAP + HELD + BY_SUBJECT + " SELECT * REPLACE (round(ts, 6) AS ts) FROM prs"))
def p2_pair_points_near(spark, sf):
    """Pairs whose readings have minutes around them."""
    found = trends.pair_points(placed(spark, sf), attributed(spark, sf), view(spark, sf, "minutes_near"))
    return rounded(found, 6, "ts")


@query(sql("sessions uploads readings minutes", ATT + PLC + GAP + HELD + BY_REF + " SELECT * REPLACE (round(ts, 6) AS ts) FROM prs"))
def p2_pair_points_all_minutes(spark, sf):
    found = trends.pair_points(
        placed(spark, sf), attributed(spark, sf), view(spark, sf, "minutes"),
        require_offset=False, by_subject=False,
    )
    return rounded(found, 6, "ts")


@query(sql("sessions uploads readings minutes", ATT + PLC + GAP + HELD + BY_REF + """
  SELECT reading_id, round(hr_ppg - pulse, 6) AS difference, round((hr_ppg + pulse) / 2, 6) AS mean_of_both
  FROM prs WHERE hr_ppg IS NOT NULL"""))
def c10_agreement(spark, sf):
    found = trends.pair_points(
        placed(spark, sf), attributed(spark, sf), view(spark, sf, "minutes"),
        require_offset=False, by_subject=False,
    )
    return rounded(
        trends.agreement(found).select("reading_id", "difference", "mean_of_both"), 6, "difference", "mean_of_both"
    )


@query(sql("sessions uploads readings minutes", ATT + PLC + GAP + HELD + BY_REF + """
  SELECT subject_id, count(*) AS n, round(avg(hr_ppg - pulse), 6) AS bias,
         round(avg(hr_ppg - pulse) - 1.96 * stddev_samp(hr_ppg - pulse), 6) AS lower,
         round(avg(hr_ppg - pulse) + 1.96 * stddev_samp(hr_ppg - pulse), 6) AS upper
  FROM prs WHERE hr_ppg IS NOT NULL GROUP BY 1"""))
def c10_agreement_limits(spark, sf):
    found = trends.pair_points(
        placed(spark, sf), attributed(spark, sf), view(spark, sf, "minutes"),
        require_offset=False, by_subject=False,
    )
    return rounded(trends.agreement_limits(found), 6, "bias", "lower", "upper")


@query(sql("sessions uploads readings", ATT + PLC + COV + " SELECT day, subject_id, recorded_minutes, sessions FROM cov WHERE sessions > 0"))
def d11_recorded_by_day(spark, sf):
    return coverage(spark, sf).where("sessions > 0").select("day", "subject_id", "recorded_minutes", "sessions")


HQ = """SELECT floor(ts / 3600) * 3600 AS bucket, {k} CASE WHEN isfinite(avg(sqi){f}) THEN round(avg(sqi){f}, 9) END AS sqi,
  CASE WHEN isfinite(avg(hr_ppg)) THEN round(avg(hr_ppg), 9) END AS hr, count(*) AS minutes,
  CASE WHEN isfinite(avg(acc_motion)) THEN round(avg(acc_motion), 9) END AS motion
  FROM minutes GROUP BY ALL"""


@query(sql("minutes", " " + HQ.format(k="", f="")))
def d12_hourly_quality(spark, sf):
    return trends.hourly_quality(view(spark, sf, "minutes"), NOW, digits=(9, 9, 9))


@query(sql("minutes", " " + HQ.format(k="subject_id,", f=" FILTER (WHERE NOT isnan(sqi))")))
def d12_hourly_quality_by_subject(spark, sf):
    return trends.hourly_quality(view(spark, sf, "minutes"), NOW, keys=("subject_id",), skip_nan=True, digits=(9, 9, 9))


DAY = f""", dpt AS (SELECT *, strftime({LOCAL_TS}, '%Y-%m-%d') AS day,
   row_number() OVER (PARTITION BY subject_id, strftime({LOCAL_TS}, '%Y-%m-%d') ORDER BY ts) - 1 AS pos,
   count(*) OVER (PARTITION BY subject_id, strftime({LOCAL_TS}, '%Y-%m-%d')) AS cnt FROM {{src}}),
dsum AS (SELECT subject_id, day, median(sys) AS sys, median(dia) AS dia, min(sys) AS sys_lo, max(sys) AS sys_hi,
   median(pulse) AS pulse, count(*) AS n, bool_or(sys < 90) AS any_low, max(ts) FILTER (WHERE pos = cnt // 2) AS ts
   FROM dpt GROUP BY 1, 2)"""


@query(sql("readings", PLC + PTS + DAY.format(src="pts") + " SELECT * REPLACE (round(ts, 6) AS ts) FROM dsum"))
def d13_daily_summary(spark, sf):
    return rounded(trends.daily_summary(points(spark, sf), TZ), 6, "ts")


@query(sql("readings", PLC + PTS + """, sz AS (SELECT subject_id, count(*) > 100 AS aggregated FROM pts GROUP BY 1),
  big AS (SELECT * FROM pts JOIN sz USING (subject_id) WHERE aggregated)""" + DAY.format(src="big") + """
  SELECT subject_id, round(ts, 6) AS ts, sys, dia, pulse, sys_lo, sys_hi, n, any_low, TRUE AS aggregated FROM dsum
  UNION ALL SELECT subject_id, round(ts, 6), sys, dia, pulse, sys, sys, 1, sys < 90, FALSE
  FROM pts JOIN sz USING (subject_id) WHERE NOT aggregated"""))
def d14_adaptive_points(spark, sf):
    return rounded(trends.adaptive_points(points(spark, sf), TZ, detail_limit=100), 6, "ts")


@query(sql("readings", PLC + PTS + f" SELECT reading_id, round(hour({LOCAL_TS}) + minute({LOCAL_TS}) / 60, 6) AS hour, sys < 90 AS low FROM pts"))
def d15_hour_of_day(spark, sf):
    return rounded(trends.hour_of_day(points(spark, sf), TZ), 6, "hour").select("reading_id", "hour", "low")


@query(sql("readings", PLC + PTS + f" SELECT subject_id, CAST(hour({LOCAL_TS}) AS INTEGER) AS hour, median(sys) AS sys, median(dia) AS dia, count(*) AS n FROM pts GROUP BY 1, 2"))
def d15_hour_profile(spark, sf):
    return trends.hour_profile(points(spark, sf), TZ)


@query(sql("sessions uploads readings", ATT + PLC + COV + """ SELECT day, round(sum(recorded_minutes), 4) AS minutes, sum(cuff_count)::BIGINT AS cuff,
   (SELECT round(greatest(10, max(s)), 4) FROM (SELECT sum(recorded_minutes) AS s FROM cov GROUP BY day)) AS scale_max FROM cov GROUP BY 1"""))
def d16_coverage_totals(spark, sf):
    return rounded(trends.coverage_totals(coverage(spark, sf)), 4, "minutes", "scale_max")


RUNS = """, stp AS (SELECT {k}, ts, ts - lag(ts) OVER (PARTITION BY {k} ORDER BY ts) AS step FROM {src}),
 rns AS (SELECT {k}, ts, sum(CASE WHEN step > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM stp)
 SELECT {k}, run, round(min(ts), 6) AS first_ts, round(max(ts), 6) AS last_ts, count(*) AS points FROM rns GROUP BY ALL"""


@query(sql("readings", PLC + PTS + RUNS.format(k="subject_id", src="pts", gap=36 * 3600)))
def e13_reading_runs(spark, sf):
    found = trends.run_summary(points(spark, sf), ["subject_id"], "ts", trends.READING_GAP_S)
    return rounded(found, 6, "first_ts", "last_ts")


@query(sql("minutes", RUNS.format(k="subject_id", src="minutes", gap=3 * 3600)))
def e13_quality_runs(spark, sf):
    found = trends.run_summary(view(spark, sf, "minutes"), ["subject_id"], "ts", trends.QUALITY_GAP_S)
    return rounded(found, 6, "first_ts", "last_ts")


@query(sql("readings", PLC + PTS + " SELECT * EXCLUDE (rn) REPLACE (round(ts, 6) AS ts) FROM ranked WHERE rn <= 25"))
def f5_capped_points(spark, sf):
    return rounded(trends.newest_points(points(spark, sf), 25), 6, "ts")


@query(sql("readings", PLC + """ SELECT reading_id, subject_id, taken_at FROM (SELECT *, row_number() OVER
   (PARTITION BY subject_id ORDER BY taken_at DESC, reading_id) AS rn FROM plc) WHERE rn <= 15"""))
def f8_recent_per_subject(spark, sf):
    who = placed(spark, sf).select("reading_id", "subject_id", "taken_at")
    return top_per_group(who, ["subject_id"], [desc("taken_at"), asc("reading_id")], 15)


@query(sql("minutes", f" SELECT bucket, sqi, sqi >= 0.8 AS usable FROM ({HQ.format(k='', f='')}) WHERE sqi IS NOT NULL"))
def d12_quality_flags(spark, sf):
    hourly = trends.hourly_quality(view(spark, sf, "minutes"), NOW, digits=(9, 9, 9))
    return trends.quality_flags(hourly).select("bucket", "sqi", "usable")


