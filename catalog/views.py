"""The store's tables, as views of the shared test tables.

Each view is one SELECT with a few words that differ between the two SQL dialects, so the
queries and their counterparts read exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavecohort.session import prepare

NOW = 1706659200.0  # 2024-01-31T00:00:00Z
TZ = "Europe/Stockholm"

WORDS = {
    "spark": {
        "@STR": "STRING",
        "@EPOCH": "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6",
        "@K": "CAST(get_json_object(props, '$.k') AS INT)",
        "@WALL": "date_format(CAST(ts AS TIMESTAMP), \"yyyy-MM-dd'T'HH:mm:ss\")",
        "@FLAT": "SELECT vec_id, label, pos, v FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, v",
        "@SHA": "sha2",
        "@256": ", 256",
    },
    "duckdb": {
        "@STR": "VARCHAR",
        "@EPOCH": "epoch(ts)",
        "@K": "CAST(json_extract_string(props, '$.k') AS INTEGER)",
        "@WALL": "strftime(ts, '%Y-%m-%dT%H:%M:%S')",
        "@FLAT": (
            "SELECT vec_id, label, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS v "
            "FROM embeddings"
        ),
        "@SHA": "sha256",
        "@256": "",
    },
}

_SUBJECT = (
    "CASE WHEN user_id % 20 = 19 THEN NULL WHEN user_id % 20 = 18 THEN '' "
    "ELSE 'p' || lpad(CAST(user_id % 20 AS @STR), 2, '0') END"
)

VIEWS = {
    "ev": (
        (),
        f"""SELECT event_id, ts, @EPOCH AS epoch, @WALL AS wall, user_id, event_type, value,
                   @K AS k, {_SUBJECT} AS subject FROM events""",
    ),
    "readings": (
        ("ev",),
        """SELECT 'r' || CAST(event_id AS @STR) AS reading_id, wall AS taken_at,
                  80 + k AS sys, CAST(50 + floor(k / 2.0) AS INT) AS dia,
                  CAST(40 + floor(value / 4) AS INT) AS pulse, k % 9 = 0 AS ihb,
                  CASE WHEN k % 4 = 0 THEN NULL ELSE k % 8 = 1 END AS mov,
                  'cuff' || CAST(k % 3 AS @STR) AS device, subject AS uploader_phone_id,
                  epoch + 3600 AS uploaded_at, CASE WHEN k % 6 = 0 THEN NULL ELSE wall END AS phone_read_at,
                  CASE WHEN k % 10 = 0 THEN NULL ELSE (k - 50) / CAST(5 AS DOUBLE) END AS clock_offset_s,
                  CAST(0.5 AS DOUBLE) AS clock_offset_uncertainty_s,
                  CASE WHEN k % 10 = 6 THEN NULL ELSE k % 10 <> 2 END AS clock_valid,
                  CASE WHEN k % 10 = 5 THEN NULL ELSE k % 10 = 1 END AS clock_suspect, k AS slot
           FROM ev WHERE event_type = 'purchase'""",
    ),
    "sessions": (
        ("ev",),
        """SELECT event_id AS id, 'u' || CAST(event_id AS @STR) AS session_uuid, epoch AS start_time,
                  CASE WHEN k % 7 = 0 THEN NULL ELSE epoch + value * 60 END AS end_time,
                  'dev' || CAST(k % 4 AS @STR) AS device_name, 'addr' AS device_address,
                  '{"ppg": 176}' AS settings, event_id * 1000 AS epoch_offset_ns, k % 60 AS rotation_period_minutes
           FROM ev WHERE event_type = 'view'""",
    ),
    "uploads": (
        ("ev",),
        """SELECT 'u' || CAST(event_id AS @STR) AS phone_session_uuid, subject AS uploader_phone_id,
                  'dev' || CAST(k % 4 AS @STR) AS device_name, epoch AS opened_at,
                  epoch + 60 + value AS completed_at, 'complete' AS status,
                  CAST(NULL AS @STR) AS files_json,
                  CASE WHEN k % 20 = 0 THEN 'oops' WHEN k % 20 = 1 THEN NULL
                       ELSE '{"samples_per_sensor": {"acc": ' || CAST(k AS @STR) || ', "ppg": '
                            || CAST(k * 10 AS @STR) || '}, "segments": 1}' END AS convert_stats_json
           FROM ev WHERE event_type = 'view' AND event_id % 10 <> 0
           UNION ALL
           SELECT 's' || CAST(event_id AS @STR), subject, 'dev', 
                  CASE WHEN k = 98 THEN NULL WHEN k < 2 THEN 1706659200.0 - k * 600 - 60
                       ELSE 1706659200.0 - k * CAST(3600 AS DOUBLE) END,
                  CASE WHEN k % 3 = 2 THEN epoch END,
                  CASE WHEN k % 3 = 0 THEN 'open' WHEN k % 3 = 1 THEN 'error' ELSE 'complete' END, '{}', NULL
           FROM ev WHERE event_type = 'signup'""",
    ),
    "minutes": (
        ("ev",),
        """SELECT epoch AS ts, 'u' || CAST(event_id AS @STR) AS label, 40 + value / 4 AS hr_ppg,
                  CASE WHEN k = 13 THEN CAST('NaN' AS DOUBLE) ELSE k / CAST(100 AS DOUBLE) END AS sqi,
                  k / CAST(50 AS DOUBLE) AS perfusion, value / 10 AS acc_motion, k AS n_ppg,
                  coalesce(nullif(subject, ''), 'unknown') AS subject_id
           FROM ev WHERE event_type = 'click'""",
    ),
    "minutes_near": (
        ("ev",),
        """SELECT epoch - 3600 + (k - 50) * CAST(3 AS DOUBLE) + n AS ts, 40 + value / 4 + n AS hr_ppg,
                  CASE WHEN k = 13 THEN CAST('NaN' AS DOUBLE) ELSE k / CAST(100 AS DOUBLE) END AS sqi,
                  coalesce(nullif(subject, ''), 'unknown') AS subject_id
           FROM ev CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 20 UNION ALL SELECT 45) x WHERE event_type = 'purchase'""",
    ),
    "held_samples": (
        ("ev",),
        """SELECT event_id - 1 - k % 3 AS session_id, event_id AS timestamp_ns,
                  CASE event_type WHEN 'click' THEN 'ppg' WHEN 'error' THEN 'acc' ELSE 'gyro' END AS sensor
           FROM ev WHERE event_type <> 'view'""",
    ),
    "notes": (
        ("ev",),
        """SELECT event_id - event_id % 5 AS session_id, epoch AS ts,
                  CASE WHEN k = 50 THEN '{bad'
                       ELSE '{"event":"' || CASE WHEN k < 10 THEN 'calibration_start'
                            WHEN k < 20 THEN 'calibration_stop' ELSE 'comment' END
                            || '","name":"n' || CAST(k AS @STR) || '","tags":["a","b' || CAST(k % 3 AS @STR)
                            || '"]}' END AS note
           FROM ev WHERE event_type = 'error'""",
    ),
    "flat": (
        (),
        """SELECT label AS session_id,
                  CAST(vec_id AS BIGINT) * 64 * 40000000 + pos * CAST(40000000 AS BIGINT)
                    + CASE WHEN pos >= 40 THEN 7000000 ELSE 0 END AS timestamp_ns,
                  pos, CAST(round(CAST(v AS DOUBLE) * 1000000) AS BIGINT) AS x
           FROM (@FLAT) f""",
    ),
    "ppg": (
        ("flat",),
        """SELECT session_id, timestamp_ns, x + pos AS ppg0,
                  CASE WHEN session_id % 2 = 1 THEN 2 * x ELSE 0 END + pos AS ppg1,
                  CAST(floor(x / 2.0) AS BIGINT) + pos AS ppg2, CAST(pos AS BIGINT) AS ambient FROM flat""",
    ),
    "motion": (
        ("flat",),
        """SELECT 'acc' AS sensor, session_id, timestamp_ns, x / CAST(1000 AS DOUBLE) AS x,
                  x / CAST(-500 AS DOUBLE) AS y, pos / CAST(10 AS DOUBLE) AS z FROM flat
           UNION ALL
           SELECT 'gyro', session_id, timestamp_ns, x / CAST(2000 AS DOUBLE), x / CAST(-800 AS DOUBLE),
                  pos / CAST(5 AS DOUBLE) FROM flat WHERE session_id % 2 = 0""",
    ),
    "files": (
        (),
        """SELECT 'u' || CAST(doc_id % 97 AS @STR) AS upload, 
                  CASE WHEN doc_id % 11 = 0 THEN 'manifest.json' WHEN doc_id % 13 = 0 THEN '../x.rop'
                       WHEN doc_id % 7 = 0 THEN 'a b.rop' ELSE 'seg-' || CAST(doc_id % 19 AS @STR) || '.rop' END AS name,
                  doc_id AS seq, text, 
                  CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 'bad'
                       ELSE @SHA(text@256) END AS declared
           FROM documents""",
    ),
    "grants": (
        (),
        """SELECT r_name AS viewer, n_nationkey AS nk,
                  CASE WHEN n_nationkey % 11 = 0 THEN NULL
                       WHEN n_nationkey % 5 = 1 THEN ' '
                       ELSE 'p' || lpad(CAST(n_nationkey % 20 AS @STR), 2, '0') END AS subject
           FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
}

TABLES = ("events", "embeddings", "documents", "nation", "region", "lineitem", "orders", "pages")


def _closure(name: str, seen: list[str]) -> list[str]:
    for need in VIEWS[name][0]:
        _closure(need, seen)
    if name not in seen:
        seen.append(name)
    return seen


def _say(sql: str, dialect: str) -> str:
    for word, text in WORDS[dialect].items():
        sql = sql.replace(word, text)
    return sql


def ctes(names: tuple[str, ...], dialect: str) -> str:
    seen: list[str] = []
    for name in names:
        _closure(name, seen)
    return ",\n".join(f"{n} AS ({_say(VIEWS[n][1], dialect)})" for n in seen)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One view as a DataFrame."""
    prepare(spark, sf)
    text = f"WITH {ctes((name,), 'spark')} SELECT * FROM {name}"
    needed = [t for t in TABLES if f"FROM {t}" in text or f"JOIN {t} " in text]
    for t in needed:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(_params(text, needed), **{t: table(spark, sf, t) for t in needed})


def _params(text: str, needed: list[str]) -> str:
    """Double the braces of JSON literals, so that only table names are parameters."""
    text = text.replace("{", "{{").replace("}", "}}")
    for t in needed:
        text = text.replace("{{" + t + "}}", "{" + t + "}")
    return text


def store(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """All tables of the store by their stored names."""
    motion = view(spark, sf, "motion")
    axes = ["session_id", "timestamp_ns", "x", "y", "z"]
    return {
        "uploads": view(spark, sf, "uploads"),
        "cuff_readings": view(spark, sf, "readings"),
        "sessions": view(spark, sf, "sessions"),
        "notes": view(spark, sf, "notes"),
        "ppg": view(spark, sf, "ppg"),
        "acc": motion.where("sensor = 'acc'").select(*axes),
        "gyro": motion.where("sensor = 'gyro'").select(*axes),
        "derived_ppg_minute": view(spark, sf, "minutes"),
    }


def sql(views: str, body: str) -> str:
    """A counterpart: the views it needs, further CTEs, and the final SELECT."""
    return f"WITH RECURSIVE {ctes(tuple(views.split()), 'duckdb')}{body}"
