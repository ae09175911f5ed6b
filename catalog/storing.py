"""Landing, merging, snapshots, composed plans and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.collection import ALL_STATE, ATT, BLG, CLK, GAP, HELD, PLC, QLT, attributed, placed, rounded
from catalog.collection import STORE_RULES_SQL, SUBJECT_RULES_SQL
from catalog.signals import BAND, ENV, IDX, MOVE, PEAK, PIDX
from catalog.views import NOW, TZ, sql, store, table, view
from wavecohort.operators import merge
from wavecohort.plans import ingest
from wavecohort.plans.series import Series
from wavecohort.plans.status import CollectionStatus
from wavecohort.plans.waveforms import waveforms
from wavecohort.schemas import READING_WIRE_DDL, schema_of
from wavecohort.session import data_files, durable, input_partitions, intermediate, prepare
from wavecohort.sources import bundles, snapshots
from wavecohort.sources.samples import SampleTable
from wavecohort.functions.values import allowed_name, allowed_size, reading_key
from wavecohort.streaming import stateful, streams

QUERIES = {}
ORACLE = {}


def query(counterpart: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if counterpart is not None:
            ORACLE[fn.__name__] = counterpart
        return fn

    return keep


def folder(spark: SparkSession, name: str) -> str:
    return intermediate(spark, name)


# ---- landing

def _manifest_text(spark, sf) -> DataFrame:
    s = view(spark, sf, "sessions")
    text = F.to_json(
        F.struct(
            "session_uuid",
            F.col("start_time").alias("started_at"),
            F.col("end_time").alias("ended_at"),
            "device_name",
            F.from_json("settings", "map<string,int>").alias("settings"),
            "epoch_offset_ns",
            "rotation_period_minutes",
            F.array(F.concat("session_uuid", F.lit(".rop"))).alias("rop_files"),
        )
    )
    return s.select(F.when(F.col("id") % 50 == 0, F.lit("{broken")).otherwise(text).alias("text"))


MAN = " SELECT session_uuid, start_time AS started_at, end_time AS ended_at, device_name, 176 AS ppg_rate, epoch_offset_ns, rotation_period_minutes, session_uuid || '.rop' AS first_file FROM sessions WHERE id % 50 <> 0 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM sessions WHERE id % 50 = 0"


@query(sql("sessions", MAN))
def a1_manifests(spark, sf):
    m = bundles.parse_manifests(_manifest_text(spark, sf), "text")
    return m.select(
        "session_uuid", "started_at", "ended_at", "device_name", F.col("settings")["ppg"].alias("ppg_rate"),
        "epoch_offset_ns", "rotation_period_minutes", F.get("rop_files", F.lit(0)).alias("first_file"),
    )


@query(sql("notes", """ SELECT session_id, CASE WHEN json_valid(note) THEN json_extract_string(note, '$.event') END AS event,
  CASE WHEN json_valid(note) THEN json_extract_string(note, '$.name') END AS name, CASE WHEN NOT json_valid(note) THEN note END AS broken FROM notes"""))
def a2_note_lines(spark, sf):
    parsed = bundles.parse_lines(view(spark, sf, "notes"), "note", "event string, name string, tags array<string>")
    return parsed.select("session_id", "event", "name", F.col(bundles.CORRUPT).alias("broken"))


def _landed(spark, sf) -> tuple[str, DataFrame]:
    """Bundles of the sample tables, landed as files: one folder per recording."""
    root = folder(spark, "landing")
    ppg = view(spark, sf, "ppg").withColumn("bundle", F.concat(F.lit("rec-"), F.col("session_id").cast("string")))
    typed = ppg.select("bundle", "timestamp_ns", *[F.col(c) for c in ("ppg0", "ppg1", "ppg2", "ambient")])
    # Every recording is landed twice, as when a bundle is completed two times.
    typed.unionByName(typed).write.partitionBy("bundle").parquet(f"{root}/ppg")
    return root, ppg


@query(sql("ppg", " SELECT session_id AS recording, count(*) AS samples, min(timestamp_ns) AS first_ns, sum(ppg0)::BIGINT AS ppg0_sum FROM ppg GROUP BY 1"))
def a3_landed_samples(spark, sf):
    prepare(spark, sf)
    root, _ = _landed(spark, sf)
    landed = spark.read.parquet(f"{root}/ppg")
    ids = landed.withColumn("session_id", F.regexp_extract("bundle", r"(\d+)$", 1).cast("bigint")).drop("bundle")
    kept, _lost = merge.drop_repeats(ids)
    path = folder(spark, "samples")
    bundles.write_samples(kept, path, buckets=16)
    return spark.read.parquet(path).groupBy(F.col("session_id").alias("recording")).agg(
        F.count("*").alias("samples"), F.min("timestamp_ns").alias("first_ns"), F.sum("ppg0").alias("ppg0_sum")
    )


def _place(spark, rows: DataFrame, root: str, name: str, fmt: str, into: str = "") -> None:
    """Land rows as ``<bundle>/<name>`` below ``root``, a folder of part files for each bundle (there are as many as recordings)."""
    at = folder(spark, "parts")
    rows.write.partitionBy("bundle").format(fmt).save(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in fs.listStatus(path(at)):
        bundle = entry.getPath().getName()
        if bundle.startswith("bundle="):
            home = f"{root}/{bundle.removeprefix('bundle=')}{into}"
            fs.mkdirs(path(home))
            fs.rename(entry.getPath(), path(f"{home}/{name}"))


def _bundles(spark, sf) -> str:
    """All recordings as bundles: manifest, optical samples, intervals between beats, notes; every third one is sent twice."""
    root = folder(spark, "bundles")
    ppg = view(spark, sf, "ppg")
    named = ppg.withColumn("bundle", F.concat(F.lit("rec-"), F.col("session_id").cast("string")))
    ids = named.groupBy("bundle", "session_id").agg(F.min("timestamp_ns").alias("first"))
    manifest = F.struct(
        F.concat(F.lit("u"), F.col("session_id").cast("string")).alias("session_uuid"), (F.col("first") / 1e9).alias("started_at"),
        F.lit("dev").alias("device_name"), F.array(F.lit("a.rop"), F.lit("b.rop")).alias("rop_files"),
    )
    note = F.to_json(F.struct(F.lit("comment").alias("event"), (F.col("first") / 1e9).alias("ts")))
    beats = named.where("timestamp_ns % 5 = 0").select(
        "bundle", "timestamp_ns", F.col("ppg0").alias("interval"), F.when(F.col("ppg1") % 2 == 0, F.col("ppg1")).alias("error")
    )
    for again in (False, True):
        kept = F.col("session_id") % 3 == 0 if again else F.lit(True)
        into = "-again" if again else ""
        _place(spark, ids.where(kept).select("bundle", F.to_json(manifest).alias("value")), root, "manifest.json", "text", into)
        _place(spark, ids.where(kept).select("bundle", note.alias("value")), root, "notes.jsonl", "text", into)
        _place(spark, named.where(kept).drop("session_id"), root, "ppg.parquet", "parquet", into)
        some = beats.where(F.regexp_extract("bundle", r"(\d+)$", 1).cast("int") % 3 == 0) if again else beats
        _place(spark, some, root, "ppi.parquet", "parquet", into)
    return root


@query(sql("ppg", """ , p AS (SELECT session_id, count(*) AS ppg, sum(ppg0)::BIGINT AS ppg0_sum FROM ppg GROUP BY 1),
  b AS (SELECT session_id, count(*) AS ppi, sum(ppg0)::BIGINT AS interval_sum, count(*) FILTER (WHERE ppg1 % 2 = 0) AS errors FROM ppg WHERE timestamp_ns % 5 = 0 GROUP BY 1)
  SELECT 'u' || session_id AS session_uuid, ppg, ppg0_sum, ppi, interval_sum, errors, 1 AS notes, 2 AS rop_files,
    CASE WHEN session_id % 3 = 0 THEN ppg ELSE 0 END AS repeated FROM p JOIN b USING (session_id)"""))
def a3_converted_bundles(spark, sf):
    """Whole bundles through the file readers, a sensor without a table of its own and repeats included."""
    prepare(spark, sf)
    root = _bundles(spark, sf)
    out = ingest.convert_bundles(spark, root, "parquet", ("ppg", "ppi"))
    sums = out["ppg"].groupBy("session_id").agg(F.sum("ppg0").alias("ppg0_sum"))
    beats = out["ppi"].groupBy("session_id").agg(
        F.sum(bundles.field("interval")).cast("bigint").alias("interval_sum"), F.count(bundles.field("error")).alias("errors")
    )
    landed = bundles.read_samples(spark, root, "ppg").groupBy(F.regexp_extract("bundle", r"^rec-(\d+)", 1).cast("bigint").alias("n")).agg(F.count("*").alias("sent"))
    counts = out["stats"].select(
        "session_uuid", F.col("db_session_id").alias("session_id"), F.col("samples_per_sensor")["ppg"].alias("ppg"), F.col("samples_per_sensor")["ppi"].alias("ppi"),
        "notes", "rop_files", F.substring("session_uuid", 2, 20).cast("bigint").alias("n"),
    )
    return counts.join(sums, "session_id").join(beats, "session_id").join(landed, "n").select(
        "session_uuid", "ppg", "ppg0_sum", "ppi", "interval_sum", "errors", "notes", "rop_files", (F.col("sent") - F.col("ppg")).alias("repeated")
    )


@query(sql("ppg motion", """ , n AS (SELECT session_id, count(*) AS ppg FROM ppg GROUP BY 1),
  a AS (SELECT session_id, count(*) FILTER (WHERE sensor = 'acc') AS acc, nullif(count(*) FILTER (WHERE sensor = 'gyro'), 0) AS gyro FROM motion GROUP BY 1)
  SELECT session_id, ppg, acc, gyro, CASE WHEN gyro IS NULL THEN 2 ELSE 3 END AS sensors FROM n JOIN a USING (session_id)"""))
def a4_sample_counts(spark, sf):
    t = store(spark, sf)
    counts = bundles.sample_counts({s: t[s] for s in ("ppg", "acc", "gyro")}, "session_id")
    one = lambda s: F.col("samples_per_sensor")[s].alias(s)
    return counts.select("session_id", one("ppg"), one("acc"), one("gyro"), F.size("samples_per_sensor").alias("sensors"))


def _wire_text(spark, sf) -> DataFrame:
    r = view(spark, sf, "readings")
    sent = F.struct(
        F.col("reading_id").alias("id"), F.col("taken_at").alias("ts"), "sys", "dia", "pulse", "mov", "device", "clock_offset_s", "clock_suspect"
    )
    return r.select(F.to_json(sent).alias("text"))


@query(sql("readings", """ SELECT reading_id, taken_at, sys, FALSE AS ihb, coalesce(mov, FALSE) AS mov, clock_offset_s,
   CAST(NULL AS BOOLEAN) AS clock_valid, coalesce(clock_suspect, FALSE) AS clock_suspect FROM readings"""))
def a5_reading_batch(spark, sf):
    raw = bundles.parse_lines(_wire_text(spark, sf), "text", READING_WIRE_DDL)
    rows = bundles.wire_readings(raw, F.lit("phone"), NOW)
    return rows.select("reading_id", "taken_at", "sys", "ihb", "mov", "clock_offset_s", "clock_valid", "clock_suspect")


FIL = """, fl AS (SELECT upload, name, seq, octet_length(encode(text)) AS bytes, sha256(text) AS sha, declared FROM files),
 vd AS (SELECT *, CASE WHEN NOT regexp_full_match(name, 'manifest\\.json|segments\\.jsonl|notes\\.jsonl|notes\\.csv|[A-Za-z0-9][A-Za-z0-9._-]*\\.rop')
    OR name LIKE '%/%' OR name LIKE '%..%' THEN 'illegal_name' WHEN bytes = 0 THEN 'empty' WHEN bytes > {limit} THEN 'too_large'
    WHEN declared IS NULL THEN 'undeclared' WHEN declared = sha THEN 'ok' ELSE 'mismatch' END AS verdict FROM fl)"""


def staged(spark, sf) -> DataFrame:
    return view(spark, sf, "files").select("upload", "name", "seq", F.col("text").alias("content"), "declared")


@query(sql("files", FIL.format(limit=200 * 1024 * 1024) + " SELECT upload, name, seq, bytes, sha AS sha256, verdict FROM vd"))
def a6_file_integrity(spark, sf):
    return bundles.check_files(staged(spark, sf)).select("upload", "name", "seq", "bytes", "sha256", "verdict")


@query(sql("files", FIL.format(limit=1) + " SELECT name, verdict <> 'illegal_name' AS allowed, count(*) AS n FROM vd GROUP BY 1, 2"))
def a7_file_names(spark, sf):
    named = staged(spark, sf).withColumn("allowed", allowed_name(F.col("name")))
    return named.groupBy("name", "allowed").agg(F.count("*").alias("n"))


@query(sql("files", FIL.format(limit=4000) + " SELECT seq, bytes > 0 AND bytes <= 4000 AS accepted FROM vd"))
def a8_file_sizes(spark, sf):
    return staged(spark, sf).select("seq", allowed_size(F.octet_length("content"), 4000).alias("accepted"))


@query(sql("files", FIL.format(limit=1) + """ SELECT upload, name, max_by(sha, seq) AS sha256, max_by(bytes, seq) AS bytes FROM fl GROUP BY 1, 2"""))
def a9_file_facts(spark, sf):
    facts = bundles.check_files(staged(spark, sf))
    return merge.last_file_facts(facts, "upload", "name", "seq")


def _snapshot(spark, sf) -> tuple[str, dict[str, DataFrame]]:
    live = {n: d for n, d in store(spark, sf).items()}
    root = folder(spark, "snapshot")
    snapshots.snapshot(live, root)
    return root, live


COUNTS = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {src}"
    for name, src in {
        "uploads": "uploads", "cuff_readings": "readings", "sessions": "sessions", "notes": "notes", "ppg": "ppg",
        "acc": "motion WHERE sensor = 'acc'", "gyro": "motion WHERE sensor = 'gyro'", "derived_ppg_minute": "minutes",
    }.items()
)
ALL_VIEWS = "uploads readings sessions notes ppg motion minutes"


@query(sql(ALL_VIEWS, " " + COUNTS))
def a10_snapshot(spark, sf):
    root, live = _snapshot(spark, sf)
    return snapshots.table_counts({n: spark.read.parquet(f"{root}/{n}") for n in live})


@query(sql(ALL_VIEWS, f" SELECT table_name, row_count, row_count AS live_rows, TRUE AS verified FROM ({COUNTS})"))
def a11_snapshot_verified(spark, sf):
    root, live = _snapshot(spark, sf)
    return snapshots.verify_snapshot(spark, root, live)


@query(sql("readings", " SELECT 'cuff_readings' AS table_name, count(*) AS row_count FROM readings UNION ALL SELECT 'segments', 0"))
def a12_missing_tables(spark, sf):
    root = folder(spark, "store")
    view(spark, sf, "readings").write.parquet(f"{root}/cuff_readings")
    return snapshots.table_counts({n: bundles.load_table(spark, root, n) for n in ("cuff_readings", "segments")})


@query(sql("readings", " SELECT reading_id, sys, CAST(NULL AS DOUBLE) AS clock_offset_s, CAST(NULL AS BOOLEAN) AS clock_valid, CAST(NULL AS INTEGER) AS slot FROM readings"))
def a13_older_layout(spark, sf):
    root = folder(spark, "store")
    old = view(spark, sf, "readings").drop(*[c for c in schema_of("cuff_readings").names if c.startswith("clock") or c in ("slot", "phone_read_at")])
    old.write.parquet(f"{root}/cuff_readings")
    return bundles.load_table(spark, root, "cuff_readings").select("reading_id", "sys", "clock_offset_s", "clock_valid", "slot")


@query(sql("ppg", " SELECT timestamp_ns, ppg0, ppg1, ppg2, ambient FROM ppg WHERE session_id = 3 ORDER BY timestamp_ns"))
def a14_one_recording(spark, sf):
    path = folder(spark, "bucketed")
    bundles.write_samples(view(spark, sf, "ppg"), path, buckets=16)
    found = bundles.read_bucketed(spark, path, 3, buckets=16)
    return found.orderBy("timestamp_ns").select("timestamp_ns", "ppg0", "ppg1", "ppg2", "ambient")


# ---- merges: lineitem keys repeat, so it serves as a store and a batch of resent rows

def _sent(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber")
    return li.select(
        key.alias("reading_id"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("seq"),
        F.col("l_quantity").cast("int").alias("sys"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_extendedprice")).alias("clock_offset_s"),
        F.when(F.col("l_partkey") % 2 == 0, F.col("l_linenumber")).alias("slot"),
        (F.col("l_suppkey") % 4 == 0).alias("stored"),
        "l_extendedprice",
    )


SENT = """ sent AS (SELECT CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS reading_id,
   l_partkey * 1000000 + l_suppkey AS seq, CAST(l_quantity AS INTEGER) AS sys, l_extendedprice,
   CASE WHEN l_partkey % 3 = 0 THEN l_extendedprice END AS clock_offset_s,
   CASE WHEN l_partkey % 2 = 0 THEN l_linenumber END AS slot, l_suppkey % 4 = 0 AS stored FROM lineitem),
 tgt AS (SELECT reading_id, arg_min(sys, (seq, l_extendedprice)) AS sys, arg_min(clock_offset_s, (seq, l_extendedprice)) FILTER (WHERE clock_offset_s IS NOT NULL) AS clock_offset_s,
   arg_min(slot, (seq, l_extendedprice)) FILTER (WHERE slot IS NOT NULL) AS slot FROM sent WHERE stored GROUP BY 1),
 bat AS (SELECT * FROM sent WHERE NOT stored)"""


def _target_and_batch(spark, sf):
    prepare(spark, sf)
    sent = _sent(spark, sf)
    cols = ["reading_id", "sys", "clock_offset_s", "slot"]
    empty = sent.select(*cols).limit(0)
    order = F.struct("seq", "l_extendedprice")
    target = merge.first_writer_merge(empty, sent.where("stored"), ["reading_id"], order)
    return target, sent.where("NOT stored"), order


@query(f"WITH {SENT}" + """, u AS (SELECT reading_id, 0 AS b, 0 AS seq, 0 AS l_extendedprice, sys, clock_offset_s, slot FROM tgt
   UNION ALL SELECT reading_id, 1, seq, l_extendedprice, sys, clock_offset_s, slot FROM bat)
 SELECT reading_id, arg_min(sys, (b, seq, l_extendedprice)) AS sys,
   arg_min(clock_offset_s, (b, seq, l_extendedprice)) FILTER (WHERE clock_offset_s IS NOT NULL) AS clock_offset_s,
   arg_min(slot, (b, seq, l_extendedprice)) FILTER (WHERE slot IS NOT NULL) AS slot FROM u GROUP BY 1""")
def h1_reading_upsert(spark, sf):
    target, batch, order = _target_and_batch(spark, sf)
    return merge.first_writer_merge(target, batch, ["reading_id"], order)


@query(f"WITH {SENT}" + """ SELECT (SELECT count(*) FROM bat) AS received,
   (SELECT count(DISTINCT reading_id) FROM bat WHERE reading_id NOT IN (SELECT reading_id FROM tgt)) AS inserted,
   (SELECT count(DISTINCT reading_id) FROM sent) AS total""")
def d19_ingest_receipt(spark, sf):
    target, batch, _ = _target_and_batch(spark, sf)
    return merge.receipt(target, batch, ["reading_id"])


@query("""WITH req AS (SELECT 'o' || CAST(o_custkey AS VARCHAR) AS id, 'ph' || CAST(o_custkey % 7 AS VARCHAR) AS phone, o_orderkey FROM orders),
  known AS (SELECT DISTINCT id FROM req WHERE o_orderkey % 5 = 0)
  SELECT id AS phone_session_uuid, min(phone) AS uploader_phone_id, CAST(min(o_orderkey) AS DOUBLE) AS opened_at, 'open' AS status
  FROM req WHERE id NOT IN (SELECT id FROM known) GROUP BY 1""")
def h2_open_uploads(spark, sf):
    prepare(spark, sf)
    o = table(spark, sf, "orders").select(
        F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("phone_session_uuid"),
        F.concat(F.lit("ph"), (F.col("o_custkey") % 7).cast("string")).alias("uploader_phone_id"),
        F.lit("dev").alias("device_name"),
        F.col("o_orderkey").cast("double").alias("at"),
    )
    known = o.where(F.col("at") % 5 == 0).select("phone_session_uuid").distinct()
    fresh = merge.open_uploads(known, o, F.col("at"))
    return fresh.select("phone_session_uuid", "uploader_phone_id", "opened_at", "status")


@query("""SELECT o_custkey, epoch(max(o_orderdate)) AS changed_at, arg_max(o_orderstatus, (epoch(o_orderdate), o_orderstatus, o_orderkey)) AS status,
   arg_max(o_orderkey, (epoch(o_orderdate), o_orderstatus, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def h3_latest_status(spark, sf):
    prepare(spark, sf)
    o = table(spark, sf, "orders").select(
        "o_custkey",
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("changed_at"),
        F.col("o_orderstatus").alias("status"),
        "o_orderkey",
    )
    return merge.latest_status(o, "o_custkey", "changed_at", "status", "o_orderkey")


@query(sql("readings", " SELECT reading_id, taken_at || '|' || sys || '|' || dia || '|' || pulse AS key FROM readings"))
def h4_reading_key(spark, sf):
    key = reading_key(F.col("taken_at"), F.col("sys"), F.col("dia"), F.col("pulse"))
    return view(spark, sf, "readings").select("reading_id", key.alias("key"))


# ---- composed plans

@query(sql("sessions uploads readings minutes", ALL_STATE + CLK + BLG + QLT + f""" , w AS ({SUBJECT_RULES_SQL} UNION ALL {STORE_RULES_SQL})
  SELECT subject_id, rule, level, message, detail FROM w"""))
def p1_status_warnings(spark, sf):
    return CollectionStatus(store(spark, sf), NOW, TZ).warnings.select("subject_id", "rule", "level", "message", "detail")


@query(sql("sessions uploads readings", ALL_STATE + " SELECT subject_id, sessions, recorded_hours, cuff_readings, pairs, round(nearest_miss_s, 6) AS nearest_miss_s FROM stt WHERE subject_id IN ('p02', 'p07')"))
def p1_status_scoped(spark, sf):
    status = CollectionStatus(store(spark, sf), NOW, TZ, ["p02", "p07"])
    return rounded(status.subjects, 6, "nearest_miss_s").select(
        "subject_id", "sessions", "recorded_hours", "cuff_readings", "pairs", "nearest_miss_s"
    )


@query(sql("readings", PLC + f""" SELECT reading_id, round(t, 6) AS ts, sys, subject_id FROM plc
  WHERE NOT coalesce(clock_suspect, FALSE) AND wall_epoch >= {NOW} - 12 * 86400"""))
def p2_series_points(spark, sf):
    found = Series(store(spark, sf), NOW, TZ, days=12).cuff
    return rounded(found, 6, "ts").select("reading_id", "ts", "sys", "subject_id")


WAVE = f"""{PIDX}{BAND}{PEAK}, ev2 AS ({ENV.format(k='session_id', v='y', extra='', cap=500, src='sig')}),
 wp AS (SELECT session_id, count(*) AS points, round(sum(lo), 3) AS lo_sum, round(sum(hi), 3) AS hi_sum FROM ev2 GROUP BY 1),
 wb AS (SELECT session_id, count(*) AS n_beats, round(avg(bpm) FILTER (WHERE bpm > 30 AND bpm < 220), 1) AS mean_bpm,
   least(500, count(*) FILTER (WHERE bpm > 30 AND bpm < 220)) AS beats_kept FROM bt GROUP BY 1 HAVING count(*) >= 2),
 asked AS (SELECT DISTINCT session_id FROM ppg UNION ALL SELECT -1)"""


WAVE_SUMS = sql("ppg", WAVE + """ SELECT a.session_id, a.session_id >= 0 AS found, points, lo_sum, hi_sum, n_beats, mean_bpm, beats_kept,
   a.session_id >= 0 AND a.session_id % 2 = 0 AS has_gyro FROM asked a LEFT JOIN wp USING (session_id) LEFT JOIN wb USING (session_id)""")


def _wave_sums(ids: DataFrame, ppg: DataFrame, motion: DataFrame) -> DataFrame:
    asked = ids.unionByName(ids.select(F.lit(-1).alias("session_id")).distinct())
    known = ids.select(F.col("session_id").alias("id"), F.lit(0.0).alias("start_time"), F.lit("dev").alias("device_name"))
    out = waveforms(asked, known, ppg, motion, cap=500)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 3)
    return out.select(
        "session_id", "found", F.when(F.col("ppg").isNotNull(), F.size("ppg.t_s")).cast("bigint").alias("points"),
        total("ppg.lo").alias("lo_sum"), total("ppg.hi").alias("hi_sum"), "hr.n_beats", "hr.mean_bpm",
        F.when(F.col("hr").isNotNull(), F.size("hr.bpm")).cast("bigint").alias("beats_kept"),
        F.col("gyro").isNotNull().alias("has_gyro"),
    )


@query(WAVE_SUMS)
def p3_waveforms(spark, sf):
    ppg = view(spark, sf, "ppg")
    return _wave_sums(ppg.select("session_id").distinct(), ppg, view(spark, sf, "motion"))


@query(WAVE_SUMS)
def p3_waveforms_stored(spark, sf):
    """The same from samples stored in order, sent in two batches that interleave."""
    prepare(spark, sf)
    tables = []
    for name, keys in (("ppg", ["session_id"]), ("motion", ["sensor", "session_id"])):
        rows = view(spark, sf, name)
        stored = SampleTable(spark, folder(spark, name), rows.schema, keys, buckets=8, slice_ns=30 * 10**9)
        for late in (0, 1):
            stored.append(rows.where(F.floor(F.col("timestamp_ns") / F.lit(7 * 10**9)) % 2 == late))
        tables.append(stored.read())
    return _wave_sums(view(spark, sf, "ppg").select("session_id").distinct(), *tables)


SEEN = "session_id % 3 <> 2"
ELEMENTS = f""", head AS (SELECT session_id, {SEEN} AS found, CASE WHEN {SEEN} THEN round(min(timestamp_ns) / 1e9, 3) END AS start_time,
   CASE WHEN {SEEN} THEN 'dev' || session_id % 4 END AS device_name FROM ppg GROUP BY 1 UNION ALL SELECT -1, FALSE, NULL, NULL),
 pulse AS (WITH RECURSIVE {IDX.format(k='session_id', src=f'(SELECT * FROM ppg WHERE {SEEN} AND session_id <> 4)')[2:]}{BAND} {ENV.format(k='session_id', v='y', extra=', round_even(max(fs), 1) AS fs_hz, max(channel)::INT AS channel', cap=500, src='sig')}),
 rate AS (WITH RECURSIVE {IDX.format(k='session_id', src=f'(SELECT * FROM ppg WHERE {SEEN} AND session_id <> 4)')[2:]}{BAND}{PEAK} SELECT session_id, i, t_s, bpm FROM vb
   WHERE (m <= 500 OR r IN (SELECT (j * (m - 1)) // 499 FROM range(0, 500) q(j)))),
 moved AS (WITH {IDX.format(k='sensor, session_id', src=f'(SELECT * FROM motion WHERE {SEEN} AND session_id <> 6)')[2:]}{MOVE} {ENV.format(k='sensor, session_id', v='v', extra='', cap=500, src='sm')}),
 elements AS (SELECT session_id, 'ppg' AS block, bucket AS pos, t_s, lo, hi FROM pulse UNION ALL SELECT session_id, sensor, bucket, t_s, lo, hi FROM moved
   UNION ALL SELECT session_id, 'hr', row_number() OVER (PARTITION BY session_id ORDER BY i) - 1, round(t_s, 3), round_even(bpm, 1), round_even(bpm, 1) FROM rate),
 kinds AS (SELECT session_id, any_value(fs_hz) AS fs_hz, any_value(channel) AS channel FROM pulse GROUP BY 1)
 SELECT h.*, fs_hz, channel, block, pos, round(t_s, 3) AS t_s, lo, hi FROM head h LEFT JOIN kinds USING (session_id) LEFT JOIN elements USING (session_id)"""


@query(sql("ppg motion", ELEMENTS))
def e14_waveform_blocks(spark, sf):
    """Every element of every block: found, unknown (-1), outside the scope (every third), without pulse (4), without motion (6)."""
    ppg, motion = view(spark, sf, "ppg"), view(spark, sf, "motion")
    starts = ppg.groupBy(F.col("session_id").alias("id")).agg((F.min("timestamp_ns") / 1e9).alias("start_time"))
    sessions = starts.withColumn("device_name", F.concat(F.lit("dev"), (F.col("id") % 4).cast("string")))
    owners = starts.select("id", F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("subject_id"))
    asked = starts.select(F.col("id").alias("session_id")).unionByName(starts.select(F.lit(-1).alias("session_id")))
    out = durable(waveforms(asked, sessions, ppg.where("session_id <> 4"), motion.where("session_id <> 6"), owners, ["p0", "p1"], 500), "waveforms")
    parts = [(b, f"{b}.t_s", *((f"{b}.bpm",) * 2 if b == "hr" else (f"{b}.lo", f"{b}.hi"))) for b in ("ppg", "acc", "gyro", "hr")]
    elements = None
    for block, *columns in parts:
        zipped = F.arrays_zip(*[F.col(c).alias(n) for c, n in zip(columns, ("t", "l", "h"))])
        one = out.select("session_id", F.lit(block).alias("block"), F.posexplode(zipped).alias("pos", "e")).select(
            "session_id", "block", F.col("pos").cast("bigint").alias("pos"), F.col("e.t").alias("t_s"), F.col("e.l").alias("lo"), F.col("e.h").alias("hi")
        )
        elements = one if elements is None else elements.unionByName(one)
    head = out.select("session_id", "found", "start_time", "device_name", "ppg.fs_hz", "ppg.channel")
    return head.join(elements, "session_id", "left")


@query(ORACLE["d19_ingest_receipt"])
def p4_ingest_readings(spark, sf):
    prepare(spark, sf)
    sent = _sent(spark, sf)
    rows = sent.select(
        *[F.col(f.name) if f.name in sent.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema_of("cuff_readings").fields],
        "seq",
        "stored",
    )
    root = folder(spark, "readings")
    ingest.ingest_readings(spark, root, rows.where("stored").drop("stored"), F.col("seq"))
    return ingest.ingest_readings(spark, root, rows.where("NOT stored").drop("stored"), F.col("seq"))


# ---- streams: the input is the events table, read as a file stream

def land_batches(spark, parts: list[DataFrame], root: str, files: int) -> DataFrame:
    """A stream whose batches are the given rows, landed one after the other as exactly ``files`` files each.

    A batch is a number of files, so a part too small to fill them gets empty ones.
    """
    schema = parts[0].schema
    for done, part in enumerate(parts):
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(root)
        for _ in range((done + 1) * files - data_files(spark, root)):
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(root)


def _stream(spark, sf, name: str, change, batches: int = 1) -> DataFrame:
    """A stream over a view, landed as files first so that a file stream can pick them up, so many for each batch."""
    root = folder(spark, name)
    rows = change(view(spark, sf, name))
    if batches > 1:
        files = input_partitions(spark, sf)
        rows.repartition(batches * files).write.parquet(root)
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(root)
    rows.write.parquet(root)
    return spark.readStream.schema(rows.schema).parquet(root)


def _finish(running) -> None:
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()


def _to_table(spark, stream: DataFrame) -> DataFrame:
    out = folder(spark, "stream-out")
    running = stream.writeStream.outputMode("append").option("checkpointLocation", folder(spark, "stream-state")).trigger(
        availableNow=True
    ).format("parquet").start(out)
    _finish(running)
    return spark.read.schema(stream.schema).parquet(out)


@query(sql("readings", " SELECT reading_id, taken_at, sys, clock_offset_s FROM readings"))
def k1_upsert_stream(spark, sf):
    cols = schema_of("cuff_readings").names
    stream = _stream(spark, sf, "readings", lambda r: r.unionByName(r).select(*cols), 3)
    root = folder(spark, "readings-log")
    _finish(streams.upsert_readings(stream, root, folder(spark, "state")))
    return ingest.merged_readings(spark, root, F.col("uploaded_at")).select("reading_id", "taken_at", "sys", "clock_offset_s")


CLOSED = "WHERE bucket + 3600 <= (SELECT floor(max(ts) * 1000) / 1000 FROM minutes) - 7200"


@query(sql("minutes", f""" , h AS (SELECT floor(ts / 3600) * 3600 AS bucket, CASE WHEN isfinite(avg(sqi)) THEN round(avg(sqi), 9) END AS sqi,
  round(avg(hr_ppg), 9) AS hr, round(avg(acc_motion), 9) AS motion, count(*) AS minutes FROM minutes GROUP BY 1) SELECT * FROM h {CLOSED}"""))
def k2_hourly_stream(spark, sf):
    stream = _stream(spark, sf, "minutes", lambda m: m)
    return rounded(_to_table(spark, streams.hourly_quality(stream)), 9, "sqi", "hr", "motion")


@query(sql("minutes", """, st AS (SELECT subject_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY subject_id ORDER BY ts) > 10800 THEN 1 ELSE 0 END AS f FROM minutes),
  rn AS (SELECT *, sum(f) OVER (PARTITION BY subject_id ORDER BY ts) AS run FROM st)
  SELECT subject_id, round(min(ts), 6) AS first_ts, round(max(ts), 6) AS last_ts, count(*) AS points FROM rn GROUP BY subject_id, run
  HAVING max(ts) + 10800 <= (SELECT max(ts) FROM minutes) - 7200"""))
def k3_run_stream(spark, sf):
    stream = _stream(spark, sf, "minutes", lambda m: m.select("subject_id", "ts"))
    runs = _to_table(spark, streams.recording_runs(stream, ("subject_id",), 3 * 3600))
    return rounded(runs, 6, "first_ts", "last_ts")


@query(sql("minutes", """, doubled AS (SELECT subject_id, ts FROM minutes UNION ALL SELECT 'hot', ts FROM minutes),
  st AS (SELECT subject_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY subject_id ORDER BY ts) > 600 THEN 1 ELSE 0 END AS f FROM doubled),
  rn AS (SELECT *, sum(f) OVER (PARTITION BY subject_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM st)
  SELECT subject_id, round(min(ts), 6) AS first_ts, round(max(ts), 6) AS last_ts, count(*) AS points FROM rn GROUP BY subject_id, run"""))
def k3_hot_subject_runs(spark, sf):
    """One subject holds half of all rows; a last tick of another one lets the watermark pass every run."""
    minutes = view(spark, sf, "minutes").select("subject_id", "ts")
    rows = minutes.unionByName(minutes.withColumn("subject_id", F.lit("hot")))
    tick = minutes.groupBy(F.lit("tick").alias("subject_id")).agg((F.max("ts") + 86400.0).alias("ts"))
    stream = _by_time(spark, sf, rows.unionByName(tick), "hot-minutes", "ts")
    runs = _to_table(spark, stateful.sliced_runs(stream, ("subject_id",), 600))
    return rounded(runs, 6, "first_ts", "last_ts")


def _by_time(spark, sf, rows: DataFrame, name: str, time: str) -> DataFrame:
    """A stream of three batches in time order, each landed after the one before."""
    cuts = (float("-inf"), NOW - 20 * 86400, NOW - 10 * 86400, float("inf"))
    rows = durable(rows, name)
    parts = [rows.where((F.col(time) >= low) & (F.col(time) < high)) for low, high in zip(cuts, cuts[1:])]
    return land_batches(spark, parts, folder(spark, name), input_partitions(spark, sf))


@query(sql("sessions uploads", ATT + """ , wm AS (SELECT floor(max(start_time) * 1000) / 1000 - 3600 AS w FROM att)
  SELECT subject_id, max(start_time) AS last_ts, count(*) AS rows, any_value(w) - max(start_time) > 7200 AS stale FROM att, wm GROUP BY 1"""))
def k4_freshness_stream(spark, sf):
    rows = attributed(spark, sf).select("subject_id", F.col("start_time").alias("ts"))
    changes = stateful.freshness(_by_time(spark, sf, rows, "activity", "ts"), 7200, "1 hour")
    root = folder(spark, "freshness")
    _finish(stateful.keep_freshness(changes, root, folder(spark, "state")))
    stateful.fold_freshness(spark, root)
    return stateful.fresh_subjects(spark, root).drop("told_at")


@query(sql("sessions uploads readings", ATT + PLC + GAP + HELD + " SELECT reading_id, session_id, round(gap, 6) AS gap FROM held"))
def k5_pairing_stream(spark, sf):
    readings = _by_time(spark, sf, placed(spark, sf).select("reading_id", "subject_id", "t"), "points", "t")
    recordings = _by_time(spark, sf, attributed(spark, sf).select("id", "subject_id", "start_time", "end_time"), "spans", "start_time")
    root = folder(spark, "pairing")
    _finish(stateful.keep_pairs(stateful.pair_streams(readings, recordings, late="1 day"), root, folder(spark, "state")))
    stateful.fold_pairs(spark, root)
    found = stateful.best_pairs(spark, root).where(F.col("session_id").isNotNull())
    return found.select("reading_id", "session_id", F.round("gap", 6).alias("gap"))


@query(sql("files", FIL.format(limit=200 * 1024 * 1024) + " SELECT upload, name, seq, verdict, verdict IN ('ok', 'undeclared') AS accepted FROM vd"))
def k6_file_stream(spark, sf):
    stream = _stream(spark, sf, "files", lambda _: staged(spark, sf), 3)
    good, bad = folder(spark, "good"), folder(spark, "bad")
    _finish(streams.arriving_files(stream, good, bad, folder(spark, "state")))
    took = lambda root, ok: spark.read.parquet(root).select("upload", "name", "seq", "verdict", F.lit(ok).alias("accepted"))
    return took(good, True).unionByName(took(bad, False))




@query(sql("files", """ , fl AS (SELECT upload, name, seq, octet_length(encode(text)) AS bytes, sha256(text) AS sha, declared FROM files),
 came AS (SELECT upload, name, max(seq) AS at, arg_max(sha, seq) AS sha256, arg_max(bytes, seq) AS bytes FROM fl GROUP BY 1, 2),
 said AS (SELECT upload, name, arg_max(declared, seq) AS declared FROM fl WHERE declared IS NOT NULL GROUP BY 1, 2),
 never AS (SELECT DISTINCT upload, 'seg-' || (100 + seq) || '.rop' AS name, seq FROM fl WHERE seq % 29 = 0),
 names AS (SELECT *, NOT regexp_full_match(name, 'manifest\\.json|segments\\.jsonl|notes\\.jsonl|notes\\.csv|[A-Za-z0-9][A-Za-z0-9._-]*\\.rop') OR name LIKE '%..%' AS bad FROM came)
 SELECT upload, name, sha256, bytes, CASE WHEN bad THEN 'illegal_name' WHEN bytes = 0 THEN 'empty' WHEN declared IS NULL THEN 'undeclared'
   WHEN declared = sha256 THEN 'ok' ELSE 'mismatch' END AS verdict FROM names LEFT JOIN said USING (upload, name)
 UNION ALL SELECT upload, name, NULL, NULL, 'missing' FROM never WHERE seq + 200 <= (SELECT max(seq) FROM fl) - 10"""))
def k6_file_verdicts(spark, sf):
    """Files and declarations as two streams; some files come again and again, some never."""
    seen = staged(spark, sf).withColumn("at", F.timestamp_seconds(F.col("seq") + NOW))
    never = seen.where("seq % 29 = 0").select("upload", F.format_string("seg-%d.rop", F.col("seq") + 100).alias("name"), F.lit("00").alias("sha256"), "at", "seq")
    said = seen.where("declared is not null").select("upload", "name", F.col("declared").alias("sha256"), "at", "seq").unionByName(never)
    third = seen.agg((F.max("seq") / 3).alias("third")).first().third

    def batches(rows: DataFrame, name: str) -> DataFrame:
        rows = durable(rows, name)
        parts = [rows.where((F.col("seq") >= n * third) & ((F.col("seq") < (n + 1) * third) | F.lit(n == 2))).drop("seq") for n in range(3)]
        return land_batches(spark, parts, folder(spark, name), input_partitions(spark, sf))

    files = batches(seen.select("upload", "name", "content", "at", "seq"), "sent")
    changes = stateful.file_verdicts(files, batches(said, "said"), 200, "10 seconds")
    root = folder(spark, "verdicts")
    _finish(stateful.keep_verdicts(changes, root, folder(spark, "state")))
    stateful.fold_verdicts(spark, root)
    return stateful.current_verdicts(spark, root).drop("told_at")
