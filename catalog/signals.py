"""Signal work on the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.collection import rounded
from catalog.views import sql, view
from wavecohort.operators import signal as s
from wavecohort.operators.trends import BEAT_GAP_S, run_summary
from wavecohort.session import durable

QUERIES = {}
ORACLE = {}

KEY = ["session_id"]
CAP = 500  # small enough that the test recordings are reduced


def query(counterpart: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if counterpart is not None:
            ORACLE[fn.__name__] = counterpart
        return fn

    return keep


# Samples in order with index, count, rate and relative time, for any number of keys.
IDX = """, o AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY timestamp_ns) - 1 AS i,
    count(*) OVER (PARTITION BY {k}) AS n, (timestamp_ns - min(timestamp_ns) OVER (PARTITION BY {k})) / 1e9 AS t_s,
    timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY {k} ORDER BY timestamp_ns) AS step FROM {src}),
 fsr AS (SELECT {k}, coalesce(1e9 / median(CASE WHEN step > 0 THEN step END), 1.0) AS fs FROM o GROUP BY ALL),
 idx AS (SELECT o.*, fs, greatest(3, CAST(floor(fs * 1.5) AS BIGINT) | 1) // 2 AS hb,
    greatest(1, CAST(floor(fs * 0.05) AS BIGINT) | 1) // 2 AS hn, greatest(1, CAST(floor(fs * 0.5) AS BIGINT) | 1) // 2 AS hm,
    greatest(1, CAST(floor(fs * 0.35) AS BIGINT)) AS d FROM o JOIN fsr USING ({k}))"""
PIDX = IDX.format(k="session_id", src="ppg")
MIDX = IDX.format(k="sensor, session_id", src="motion")
# Ambient-subtracted channels, padded at both ends, then averaged over explicit neighbours.
BAND = """, chan AS (SELECT session_id, i, n, t_s, hb, hn, d, fs, unnest([0, 1, 2]) AS ch,
    unnest([ppg0 - ambient, ppg1 - ambient, ppg2 - ambient]) AS x FROM idx),
 ends AS (SELECT session_id, ch, max(x) FILTER (WHERE i = 0) AS x0, max(x) FILTER (WHERE i = n - 1) AS xn FROM chan GROUP BY 1, 2),
 cum AS (SELECT c.*, x0, xn, sum(x) OVER (PARTITION BY c.session_id, c.ch ORDER BY i) AS p FROM chan c JOIN ends USING (session_id, ch)),
 ma AS (SELECT a.session_id, a.ch, a.i, a.n, a.t_s, a.d, a.fs, a.x,
    CAST(u.p - coalesce(l.p, 0) + a.x0 * greatest(0, a.hb - a.i) + a.xn * greatest(0, a.i + a.hb - a.n + 1) AS DOUBLE) / (2 * a.hb + 1) AS base,
    CAST(v.p - coalesce(m.p, 0) + a.x0 * greatest(0, a.hn - a.i) + a.xn * greatest(0, a.i + a.hn - a.n + 1) AS DOUBLE) / (2 * a.hn + 1) AS noise
  FROM cum a JOIN cum u ON u.session_id = a.session_id AND u.ch = a.ch AND u.i = least(a.i + a.hb, a.n - 1)
  LEFT JOIN cum l ON l.session_id = a.session_id AND l.ch = a.ch AND l.i = a.i - a.hb - 1
  JOIN cum v ON v.session_id = a.session_id AND v.ch = a.ch AND v.i = least(a.i + a.hn, a.n - 1)
  LEFT JOIN cum m ON m.session_id = a.session_id AND m.ch = a.ch AND m.i = a.i - a.hn - 1),
 flt AS (SELECT *, noise - base AS y FROM ma),
 en AS (SELECT session_id, ch, var_pop(y) AS energy FROM flt GROUP BY 1, 2),
 best AS (SELECT session_id, ch AS channel, energy FROM en
   QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY energy DESC, ch) = 1),
 sig AS (SELECT f.session_id, i, n, t_s, fs, d, y, ch AS channel, sqrt(energy) AS sigma FROM flt f JOIN best b
   ON b.session_id = f.session_id AND b.channel = f.ch)"""
PEAK = """, nb AS (SELECT *, lag(y) OVER (PARTITION BY session_id ORDER BY i) AS l, lead(y) OVER (PARTITION BY session_id ORDER BY i) AS r FROM sig),
 cand AS (SELECT session_id, i, t_s, y, d, row_number() OVER (PARTITION BY session_id ORDER BY i) AS c
   FROM nb WHERE y > l AND y > r AND y > 0.3 * sigma),
 walk AS (SELECT session_id, c, i AS pi, y AS py, t_s AS pt, CAST(NULL AS BIGINT) AS done FROM cand WHERE c = 1
   UNION ALL SELECT w.session_id, k.c,
     CASE WHEN k.i - w.pi >= k.d OR k.y > w.py THEN k.i ELSE w.pi END,
     CASE WHEN k.i - w.pi >= k.d OR k.y > w.py THEN k.y ELSE w.py END,
     CASE WHEN k.i - w.pi >= k.d OR k.y > w.py THEN k.t_s ELSE w.pt END,
     CASE WHEN k.i - w.pi >= k.d THEN w.pi END
   FROM walk w JOIN cand k ON k.session_id = w.session_id AND k.c = w.c + 1),
 pk AS (SELECT c.session_id, c.i, c.t_s, c.y FROM cand c JOIN (
     SELECT session_id, done AS i FROM walk WHERE done IS NOT NULL
     UNION SELECT session_id, pi FROM walk QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY c DESC) = 1) z
   ON z.session_id = c.session_id AND z.i = c.i),
 bt AS (SELECT *, 60 / (t_s - lag(t_s) OVER (PARTITION BY session_id ORDER BY i)) AS bpm FROM pk),
 vb AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY session_id) AS m
   FROM bt WHERE bpm > 30 AND bpm < 220)"""
MOVE = """, mg AS (SELECT *, sqrt(x * x + y * y + z * z) AS g FROM idx),
 me AS (SELECT sensor, session_id, max(g) FILTER (WHERE i = 0) AS x0, max(g) FILTER (WHERE i = n - 1) AS xn FROM mg GROUP BY 1, 2),
 mc AS (SELECT mg.*, x0, xn, sum(g) OVER (PARTITION BY mg.sensor, mg.session_id ORDER BY i) AS p FROM mg JOIN me USING (sensor, session_id)),
 sm AS (SELECT a.sensor, a.session_id, a.i, a.n, a.t_s, a.fs,
    (u.p - coalesce(l.p, 0) + a.x0 * greatest(0, a.hm - a.i) + a.xn * greatest(0, a.i + a.hm - a.n + 1)) / (2 * a.hm + 1) AS v
  FROM mc a JOIN mc u ON u.sensor = a.sensor AND u.session_id = a.session_id AND u.i = least(a.i + a.hm, a.n - 1)
  LEFT JOIN mc l ON l.sensor = a.sensor AND l.session_id = a.session_id AND l.i = a.i - a.hm - 1)"""
ENV = """SELECT {k}, i // w AS bucket, round(max(t_s) FILTER (WHERE i - (i // w) * w = len // 2), 6) AS t_s,
   round(min({v}), 3) AS lo, round(max({v}), 3) AS hi{extra}
 FROM (SELECT *, least(w, n - (i // w) * w) AS len FROM (SELECT *, CAST(ceil(n / {cap}) AS BIGINT) AS w FROM {src}))
 GROUP BY {k}, i // w"""


def ppg_index(spark, sf):
    return s.sample_index(s.optical_channels(view(spark, sf, "ppg")), KEY, s.CHANNELS)


def filtered(spark, sf):
    return s.pulse_band(ppg_index(spark, sf), KEY)


def chosen(spark, sf):
    return s.chosen_signal(durable(filtered(spark, sf), "band"), KEY)


def peaks(spark, sf):
    return s.merge_peaks(s.peak_candidates(chosen(spark, sf), KEY), KEY)


@query(sql("ppg", PIDX + " SELECT session_id, round(fs, 6) AS fs FROM fsr"))
def e1_sample_rate(spark, sf):
    return rounded(s.sample_rates(view(spark, sf, "ppg"), KEY), 6, "fs")


@query(sql("ppg", PIDX + " SELECT session_id, i, n, round(t_s, 6) AS t_s FROM idx"))
def e2_relative_time(spark, sf):
    return rounded(ppg_index(spark, sf).select("session_id", "i", "n", "t_s"), 6, "t_s")


@query(sql("ppg", """ SELECT session_id, timestamp_ns, unnest(['ppg0', 'ppg1', 'ppg2']) AS channel,
  unnest([ppg0 - ambient, ppg1 - ambient, ppg2 - ambient]) AS value FROM ppg"""))
def e3_ambient_subtracted(spark, sf):
    return s.channels_long(view(spark, sf, "ppg"), KEY)


@query(sql("ppg", PIDX + BAND + " SELECT session_id, ch::BIGINT AS ch, i, round(base, 3) AS base, round(noise, 3) AS noise FROM ma"))
def e4_moving_average(spark, sf):
    widths = {"base": s.odd_width(F.col("fs"), s.BASELINE_S, 3), "noise": s.odd_width(F.col("fs"), s.NOISE_S, 1)}
    averaged = s.moving_averages(ppg_index(spark, sf), KEY, list(s.CHANNELS), widths)
    per = [F.struct(F.lit(n).cast("bigint").alias("ch"), *[F.round(f"{c}_{w}", 3).alias(w) for w in widths]) for n, c in enumerate(s.CHANNELS)]
    return averaged.select("session_id", "i", F.explode(F.array(*per)).alias("x")).select("session_id", "i", "x.*")


@query(sql("ppg", PIDX + BAND + """ SELECT session_id, i, round(max(y) FILTER (WHERE ch = 0), 3) AS ppg0,
  round(max(y) FILTER (WHERE ch = 1), 3) AS ppg1, round(max(y) FILTER (WHERE ch = 2), 3) AS ppg2 FROM flt GROUP BY 1, 2"""))
def e5_pulse_band(spark, sf):
    return rounded(filtered(spark, sf).select("session_id", "i", *s.CHANNELS), 3, *s.CHANNELS)


@query(sql("ppg", PIDX + BAND + " SELECT session_id, channel, round(energy, 2) AS energy FROM best"))
def e6_best_channel(spark, sf):
    best = s.best_channel(filtered(spark, sf), KEY)
    return rounded(best.select("session_id", "channel", "energy"), 2, "energy")


@query(sql("ppg", PIDX + BAND + " " + ENV.format(k="session_id", v="y", extra="", cap=CAP, src="sig")))
def e7_envelope(spark, sf):
    return rounded(s.envelope(chosen(spark, sf), KEY, "y", CAP), 3, "lo", "hi").withColumn("t_s", F.round("t_s", 6))


@query(sql("ppg", PIDX + BAND + PEAK + " SELECT session_id, i, round(y, 3) AS y FROM cand"))
def e8_peak_candidates(spark, sf):
    return rounded(s.peak_candidates(chosen(spark, sf), KEY).select("session_id", "i", "y"), 3, "y")


@query(sql("ppg", PIDX + BAND + PEAK + " SELECT session_id, i, round(t_s, 6) AS t_s, round(y, 3) AS y FROM pk"))
def e9_refractory_merge(spark, sf):
    return peaks(spark, sf).select("session_id", "i", F.round("t_s", 6).alias("t_s"), F.round("y", 3).alias("y"))


@query(sql("ppg", PIDX + BAND + PEAK + """ SELECT session_id, count(*) AS n_beats,
  round(avg(bpm) FILTER (WHERE bpm > 30 AND bpm < 220), 1) AS mean_bpm FROM bt GROUP BY 1 HAVING count(*) >= 2"""))
def e10_beat_rate(spark, sf):
    return s.beat_summary(s.beat_intervals(peaks(spark, sf), KEY), KEY)


@query(sql("ppg", PIDX + BAND + PEAK + """ SELECT session_id, i, round(bpm, 3) AS bpm FROM vb
  WHERE m <= 100 OR r IN (SELECT (j * (m - 1)) // 99 FROM range(0, 100) q(j))"""))
def e11_even_thinning(spark, sf):
    beats = s.beat_intervals(peaks(spark, sf), KEY).where("valid")
    return s.thin_evenly(beats, KEY, 100).select("session_id", "i", F.round("bpm", 3).alias("bpm"))


@query(sql("motion", MIDX + MOVE + " " + ENV.format(k="sensor, session_id", v="v", extra=", round(max(fs), 6) AS fs", cap=CAP, src="sm")))
def e12_motion_envelope(spark, sf):
    found = s.motion_envelope(view(spark, sf, "motion"), ["sensor", "session_id"], CAP)
    return rounded(found, 3, "lo", "hi").withColumns({"t_s": F.round("t_s", 6), "fs": F.round("fs", 6)})


@query(sql("ppg", PIDX + BAND + PEAK + """, st AS (SELECT *, CASE WHEN t_s - lag(t_s) OVER (PARTITION BY session_id ORDER BY i) > 5 THEN 1 ELSE 0 END AS f FROM vb),
  rn AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY i)::BIGINT AS run FROM st)
  SELECT session_id, run, round(min(t_s), 6) AS first_ts, round(max(t_s), 6) AS last_ts, count(*) AS points FROM rn GROUP BY 1, 2"""))
def e13_beat_runs(spark, sf):
    beats = s.beat_intervals(peaks(spark, sf), KEY).where("valid")
    return rounded(run_summary(beats, KEY, "t_s", BEAT_GAP_S), 6, "first_ts", "last_ts")
