"""Landed bundles, merges, versions and streams on files."""

import datetime
import glob
import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from catalog import storing
from wavecohort import session
from wavecohort.operators import merge, scope
from wavecohort.plans import ingest
from wavecohort.plans.waveforms import waveforms
from wavecohort.schemas import FILL_ONCE, reconcile, schema_of
from wavecohort.session import drop_intermediates, durable, intermediate_table, shared_dir, shuffle_partitions_for
from wavecohort.sources import buckets, bundles, days, snapshots
from wavecohort.streaming import streams


def wire(rid, **more):
    return {"id": rid, "ts": "2026-07-01T08:00:00", "sys": 120, "dia": 80, "pulse": 60, **more}


def batch(spark, tmp_path, name, rows, now=1.0):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "b.json").write_text("\n".join(json.dumps(r) for r in rows))
    return bundles.read_readings(spark, str(folder), F.lit("p"), now)


def stored(spark, root):
    return {r.reading_id: r for r in ingest.stored_readings(spark, root).collect()}


def test_upsert_counts_and_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "t")
    for name, ids, want in (("1", "ab", (2, 2, 2)), ("2", "abc", (3, 1, 3)), ("3", "abc", (3, 0, 3))):
        rows = batch(spark, tmp_path, name, [wire(i) for i in ids])
        r = ingest.ingest_readings(spark, root, rows, F.lit(0)).first()
        assert (r.received, r.inserted, r.total) == want
    assert len(stored(spark, root)) == 3
    assert buckets.generations(spark, f"{root}/table") == [1, 2, 3]


def written(root, since=0.0):
    """Bytes of data files below a folder that are newer than a moment."""
    found = [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")]
    return sum(os.path.getsize(f) for f in found if os.path.getmtime(f) > since)


def many(spark, ids, now, **more):
    rows = ids.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("reading_id"), F.lit(float(now)).alias("uploaded_at"), *[F.lit(v).alias(c) for c, v in more.items()])
    return reconcile(rows, schema_of("cuff_readings")).select(*schema_of("cuff_readings").names)


def test_a_small_batch_rewrites_its_buckets_only(spark, tmp_path):
    root = str(tmp_path / "t")
    ingest.ingest_readings(spark, root, many(spark, spark.range(60_000), 1, device="first"), F.lit(0))
    whole = written(root)
    mark = max(os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)
    time.sleep(0.05)
    few = many(spark, spark.createDataFrame([(5,), (6,), (99_999,)], "id long"), 2, device="second", slot=7)
    r = ingest.ingest_readings(spark, root, few, F.lit(0)).first()
    assert (r.received, r.inserted, r.total) == (3, 1, 60_001)
    assert written(f"{root}/table", mark) < whole / 20
    got = {r.reading_id: r for r in ingest.stored_readings(spark, root).where("uploaded_at = 2 or last_seen_at = 2").collect()}
    assert [(got[k].device, got[k].slot, got[k].uploaded_at, got[k].last_seen_at) for k in ("r5", "r99999")] == [("first", 7, 1.0, 2.0), ("second", 7, 2.0, 2.0)]
    before = {tuple(x) for x in ingest.stored_readings(spark, root).collect()}
    assert ingest.ingest_readings(spark, root, few, F.lit(0)).first().inserted == 0
    assert {tuple(x) for x in ingest.stored_readings(spark, root).collect()} == before and len(before) == 60_001


def test_a_generation_without_its_marker_is_not_read_and_is_written_again(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(4):
        ingest.ingest_readings(spark, root, many(spark, spark.range(n * 10, n * 10 + 20), n), F.lit(0))
    assert ingest.stored_readings(spark, root).count() == 50
    os.remove(os.path.join(root, "table", "gen=00000004", "_SUCCESS"))
    assert ingest.stored_readings(spark, root).count() == 40
    assert ingest.ingest_readings(spark, root, many(spark, spark.range(30, 50), 3), F.lit(0)).first().total == 50
    assert ingest.stored_readings(spark, root).count() == 50


def test_blank_provenance_is_filled_once_and_values_stay(spark, tmp_path):
    root = str(tmp_path / "t")
    steps = [
        [wire("a", device="first"), wire("b", clock_offset_s=-1.0)],
        [wire("a", clock_offset_s=-2.0, clock_valid=True, slot=4, device="second"), wire("b", clock_offset_s=-900.0)],
        [wire("a", clock_offset_s=-3.0)],
    ]
    for n, rows in enumerate(steps):
        ingest.ingest_readings(spark, root, batch(spark, tmp_path, str(n), rows, float(n)), F.lit(0))
    got = stored(spark, root)
    assert (got["a"].clock_offset_s, got["a"].clock_valid, got["a"].slot) == (-2.0, True, 4)
    assert (got["a"].device, got["a"].uploaded_at) == ("first", 0.0)
    assert got["b"].clock_offset_s == -1.0 and got["b"].clock_suspect is False


def test_many_copies_of_one_reading(spark):
    sent = spark.range(5000).select(F.lit("hot").alias("reading_id"), F.col("id").alias("at"), F.col("id").cast("int").alias("sys"),
                                    F.when(F.col("id") >= 3000, F.col("id")).cast("int").alias("slot"))
    target = sent.select("reading_id", "sys", "slot").limit(0)
    row = merge.first_writer_merge(target, sent, ["reading_id"], F.col("at"), FILL_ONCE).collect()
    assert [(r.sys, r.slot) for r in row] == [(0, 3000)]
    r = merge.receipt(target, sent, ["reading_id"]).first()
    assert (r.received, r.inserted, r.total) == (5000, 1, 1)


def land(spark, root, name, uuid):
    folder = root / name
    folder.mkdir(parents=True)
    (folder / "manifest.json").write_text(json.dumps({
        "session_uuid": uuid, "started_at": 10.0, "ended_at": 70.0, "device_name": "d", "settings": {"ppg": 176},
        "epoch_offset_ns": 5, "rotation_period_minutes": 10, "rop_files": ["a.rop", "b.rop"],
    }, indent=1))
    (folder / "segments.jsonl").write_text('{"event": "open", "segment_id": 1, "ts": 10}\nbroken\n')
    (folder / "notes.jsonl").write_text('{"event": "calibration_start", "ts": 11.5}\n\n')
    (folder / "notes.csv").write_text("ts,note\n12.5,hello\n")
    (folder / "ppg.csv").write_text("timestamp_ns,ppg0,ppg1,ppg2,ambient\n" + "\n".join(f"{k},{k},{k},{k},0" for k in [1, 2, 3, 3]))


def test_bundles_become_rows_and_a_repeat_counts_once(spark, tmp_path):
    root = tmp_path / "landing"
    land(spark, root, "one", "u1")
    land(spark, root, "two", "u2")
    land(spark, root, "two-again", "u2")
    out = ingest.convert_bundles(spark, str(root), "csv", ("ppg",))
    assert out["sessions"].count() == 2 and out["ppg"].count() == 6
    assert out["duplicates"].first().duplicates == 6
    assert out["notes"].count() == 4 and bundles.read_notes(spark, str(root), "csv").count() == 3
    rows = {r.session_uuid: json.loads(r.convert_stats_json) for r in out["stats"].collect()}
    assert {r.sensor: r.duplicates for r in out["duplicates"].collect()} == {"ppg": 6, "notes": 2, "segments": 2}
    assert (rows["u2"]["notes"], rows["u2"]["segments"], out["segments"].count()) == (2, 2, 4)
    assert rows["u1"]["samples_per_sensor"] == {"ppg": 3} and rows["u1"]["rop_files"] == 2
    broken = bundles.read_segments(spark, str(root)).where(F.col(bundles.CORRUPT).isNotNull())
    assert broken.count() == 3


def test_file_checks(spark, tmp_path):
    folder = tmp_path / "land" / "u1"
    folder.mkdir(parents=True)
    for name, data in (("a.rop", b"abc"), ("b.rop", b"xyz"), ("c.rop", b"free"), ("bad name.rop", b"q"), ("e.rop", b""), ("big.rop", b"z" * 50)):
        (folder / name).write_bytes(data)
    files = bundles.read_files(spark, str(tmp_path / "land"), 40)
    declared = spark.createDataFrame(
        [("u1", "a.rop", hashlib.sha256(b"abc").hexdigest()), ("u1", "b.rop", "0" * 64), ("u1", "e.rop", "1" * 64)], "upload string, name string, sha256 string"
    )
    got = {r.name: (r.verdict, r.sha256) for r in bundles.check_files(files, declared, 40).collect()}
    assert {n: v for n, (v, _) in got.items()} == {
        "a.rop": "ok", "b.rop": "mismatch", "c.rop": "undeclared", "bad name.rop": "illegal_name", "e.rop": "missing", "big.rop": "too_large",
    }
    assert got["a.rop"][1] == hashlib.sha256(b"abc").hexdigest()


def test_upload_states(spark):
    log = spark.createDataFrame([("u", 1.0, "open"), ("u", 3.0, "complete"), ("u", 2.0, "error"), ("v", 1.0, "open")], "id string, at double, status string")
    assert {r.id: r.status for r in merge.latest_status(log, "id", "at", "status").collect()} == {"u": "complete", "v": "open"}
    uploads = spark.createDataFrame([("u", "p", "d", 1.0, None, "open", "{}", None), ("w", "p", "d", 1.0, None, "open", "{}", None)], schema_of("uploads"))
    finished = spark.createDataFrame([("u", 9.0, "complete", "{}")], "phone_session_uuid string, completed_at double, status string, convert_stats_json string")
    got = {r.phone_session_uuid: (r.status, r.completed_at) for r in ingest.completed_uploads(uploads, finished).collect()}
    assert got == {"u": ("complete", 9.0), "w": ("open", None)}


def test_snapshot_verifies_and_a_missing_table_fails(spark, tmp_path):
    live = {"a": spark.range(5), "b": spark.range(7)}
    snapshots.snapshot(live, str(tmp_path / "s"))
    rows = snapshots.verify_snapshot(spark, str(tmp_path / "s"), live).collect()
    assert {(r.table_name, r.row_count, r.verified) for r in rows} == {("a", 5, True), ("b", 7, True)}
    with pytest.raises(Exception):
        snapshots.verify_snapshot(spark, str(tmp_path / "s"), {**live, "c": spark.range(1)}).collect()


def test_half_written_version_is_not_read(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.publish(spark.range(3), root)
    (tmp_path / "t" / "version=00000002").mkdir()
    assert snapshots.current(spark, root, spark.range(0)).count() == 3


def test_bucketed_samples_prune_to_one_recording(spark, tmp_path):
    ppg = spark.range(4000).select((F.col("id") % 40).alias("session_id"), F.col("id").alias("timestamp_ns"), F.lit(1).alias("ppg0"))
    bundles.write_samples(ppg, str(tmp_path / "p"), buckets=8)
    one = bundles.read_bucketed(spark, str(tmp_path / "p"), 7, buckets=8)
    assert one.count() == 100
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "session_bucket" in plan.split("PartitionFilters")[1][:80]


def test_waveform_of_unknown_and_forbidden_recordings_look_alike(spark):
    ppg = spark.range(400).select(
        F.lit(1).cast("long").alias("session_id"), (F.col("id") * 40_000_000).alias("timestamp_ns"),
        *[F.round(1000 * F.sin(F.col("id") / 4)).cast("long").alias(c) for c in ("ppg0", "ppg1", "ppg2")],
        F.lit(0).cast("long").alias("ambient"),
    )
    motion = spark.createDataFrame([], "sensor string, session_id long, timestamp_ns long, x double, y double, z double")
    sessions = spark.createDataFrame([(1, 5.0, "d"), (2, 5.0, "d")], "id long, start_time double, device_name string")
    owners = spark.createDataFrame([(1, "p"), (2, "q")], "id long, subject_id string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "session_id long")
    got = {r.session_id: r for r in waveforms(asked, sessions, ppg, motion, owners, ["p"], cap=50).collect()}
    assert (got[1].found, got[2].found, got[3].found) == (True, False, False)
    assert got[2].ppg is None and got[2].start_time is None and got[3].ppg is None
    assert len(got[1].ppg.t_s) <= 50 and got[1].ppg.fs_hz == 25.0 and got[1].ppg.channel == 0 and got[1].acc is None
    assert got[1].hr.n_beats > 5 and got[1].hr.mean_bpm == pytest.approx(60 / (8 * 3.14159 * 0.04), abs=2)


def test_shared_folder_must_be_named_off_local(spark):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://x"})

    with pytest.raises(RuntimeError):
        shared_dir(Elsewhere())


def test_streamed_upsert_fills_late_and_replays_change_nothing(spark, tmp_path):
    source, root, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "state")
    source.mkdir()
    cols = schema_of("cuff_readings")

    def arrive(name, rows, now):
        batch(spark, tmp_path, name, rows, now).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(cols).parquet(str(source))
        streams.upsert_readings(stream, root, state).awaitTermination()
        return {r.reading_id: r for r in ingest.merged_readings(spark, root, F.lit(0)).collect()}

    arrive("x", [wire("a"), wire("b")], 1.0)
    arrive("y", [wire("a", clock_offset_s=-2.0), wire("c")], 2.0)
    ingest.compact_readings(spark, root, F.lit(0))
    got = arrive("z", [wire("a", clock_offset_s=-7.0)], 3.0)
    assert set(got) == {"a", "b", "c"} and got["a"].clock_offset_s == -2.0
    assert (got["a"].uploaded_at, got["a"].last_seen_at, got["b"].last_seen_at) == (1.0, 3.0, 1.0)
    # A replayed batch replaces itself.
    ingest.log_readings(batch(spark, tmp_path, "again", [wire("a", clock_offset_s=-7.0)], 3.0), root, 2)
    assert ingest.merged_readings(spark, root, F.lit(0)).count() == 3
    ingest.compact_readings(spark, root, F.lit(0))
    ingest.compact_readings(spark, root, F.lit(0))
    assert buckets.generations(spark, f"{root}/table") == [2, 3]
    # Folded batches are gone; one written again after its fold changes nothing.
    assert os.listdir(os.path.join(root, "log")) == []
    ingest.log_readings(batch(spark, tmp_path, "late", [wire("a", slot=9), wire("zz")], 9.0), root, 1)
    plan = ingest.merged_readings(spark, root, F.lit(0))
    assert "log/batch" not in " ".join(plan.inputFiles())
    got = {r.reading_id: r for r in plan.collect()}
    assert set(got) == {"a", "b", "c"} and (got["a"].last_seen_at, got["a"].uploaded_at, got["c"].last_seen_at) == (3.0, 1.0, 2.0)
    got = arrive("w", [wire("c", clock_offset_s=1.0)], 4.0)
    assert (got["c"].clock_offset_s, got["c"].last_seen_at, got["a"].clock_offset_s) == (1.0, 4.0, -2.0)


def test_streamed_pairing_waits_for_the_recording(spark, tmp_path):
    source, root, state = tmp_path / "in", str(tmp_path / "pairing"), str(tmp_path / "state")
    source.mkdir()
    known = []

    def arrive(rows):
        df = spark.createDataFrame(rows, "reading_id string, subject_id string, t double")
        df.coalesce(1).write.mode("append").parquet(str(source))
        spans = lambda s: s.createDataFrame(known, "subject_id string, start_time double, end_time double, id long")
        stream = spark.readStream.schema(df.schema).parquet(str(source))
        streams.pair_readings(stream, spans, root, state).awaitTermination()
        return {r.reading_id for r in streams.paired(spark, root).collect()}

    assert arrive([("a", "p", 50.0)]) == set()
    known.append(("p", 0.0, 100.0, 1))
    assert arrive([("b", "p", 9000.0)]) == {"a"}
    assert arrive([("a", "p", 50.0), ("c", "p", 60.0)]) == {"a", "c"}


def test_sizes_and_cleanup(spark):
    assert shuffle_partitions_for(0, 8) == 8
    assert shuffle_partitions_for(100 * 10**12, 200) == 1_490_117
    assert shuffle_partitions_for(10**12, 200) == 14_902
    kept = durable(spark.range(3), "three")
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    assert os.path.isdir(path)
    table = intermediate_table(spark, "four")
    spark.range(4).write.saveAsTable(table)
    assert spark.table(table).count() == 4
    drop_intermediates(spark)
    assert not os.path.isdir(path) and not spark.catalog.tableExists(table)
    drop_intermediates(spark)


def land_csv(root, name, manifest, rows, notes=None):
    folder = root / name
    folder.mkdir(parents=True)
    if manifest is not None:
        (folder / "manifest.json").write_text(manifest)
    (folder / "acc.csv").write_text("timestamp_ns,x,y,z\n" + "".join(f"{t},1,2,{t % 5}\n" for t in rows))
    if notes:
        (folder / "notes.csv").write_text("ts,note\n" + notes)


def test_broken_bundles_are_set_aside_and_sent_again_counts_once(spark, tmp_path):
    fine = json.dumps({"session_uuid": "u1", "started_at": 1.0, "ended_at": 2.0, "device_name": "d", "rop_files": []})
    land_csv(tmp_path / "one", "a", fine, range(5), "1.5,hello\nsoon,later\n")
    land_csv(tmp_path / "one", "b", "{not json", range(4), "1,lost\n")
    land_csv(tmp_path / "one", "c", None, range(3))
    out = ingest.convert_bundles(spark, str(tmp_path / "one"), "csv")
    assert {r.bundle for r in out["failed"].collect()} == {"b", "c"}
    assert (out["acc"].count(), out["broken_acc"].count(), out["ppg"].count()) == (5, 7, 0)
    assert sorted((r.ts, r.note) for r in out["notes"].collect() if r.ts) == [(1.5, "hello")] and out["notes"].count() == 2
    assert out["broken_notes"].count() == 1 and out["segments"].count() == 0
    land_csv(tmp_path / "two", "a2", fine, range(2, 9))
    again = ingest.convert_bundles(spark, str(tmp_path / "two"), "csv", stored={"acc": out["acc"]})
    assert sorted(r.timestamp_ns for r in again["acc"].collect()) == [5, 6, 7, 8]
    assert {r.sensor: r.duplicates for r in again["duplicates"].collect()}["acc"] == 3


def test_csv_notes_hold_line_breaks_and_only_a_first_row_is_a_header(spark, tmp_path):
    for name, text in (("a", 'ts,note\n1.5,"two\nlines, ""quoted"""\nts,note\n2.5,plain\n'), ("b", '3.5,no header\n\nsoon,later\n')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "notes.csv").write_text(text)
    got = sorted(((r.bundle, r.ts, r.note, r[bundles.CORRUPT]) for r in bundles.read_notes(spark, str(tmp_path), "csv").collect()), key=str)
    assert got == sorted([
        ("a", 1.5, 'two\nlines, "quoted"', None), ("a", None, "note", "ts,note"), ("a", 2.5, "plain", None),
        ("b", 3.5, "no header", None), ("b", None, "later", "soon,later"),
    ], key=str)


def test_a_scoped_look_back_opens_its_folders_only(spark, tmp_path):
    rows = spark.range(3000).select(
        F.concat(F.lit("p"), (F.col("id") % 30).cast("string")).alias("who"), (F.lit(1.7e9) + F.col("id") * 1000).alias("t"), F.col("id").alias("n")
    ).unionByName(spark.createDataFrame([(None, 1.7e9, -1), ("", 1.7e9, -2), ("p1", None, -3)], "who string, t double, n long"))
    path, now = str(tmp_path / "d"), 1.7e9 + 3e6
    days.write_days(rows, path, days.day_of(F.col("t")), F.col("who"), 8)
    spark.createDataFrame([("v", ["p1", "p2"]), ("w", ["unknown"]), ("all", ["*"]), ("none", [" "])], "viewer string, s array<string>").write.parquet(str(tmp_path / "g"))
    grants = scope.resolve_grants(spark.read.parquet(str(tmp_path / "g")), "viewer", "s")
    read = lambda who, since=None: days.read_days(spark, path, rows.schema, "who", since, who, 8)
    seen = lambda viewer: scope.scope_of(grants, "viewer", viewer)
    since = days.first_day(now, 14)
    everything = rows.collect()
    first = now - 15 * 86400
    held = lambda names, bound: sorted(r.n for r in everything if r.who in names and (not bound or (r.t is not None and days_of(r.t) >= since)))
    days_of = lambda t: datetime.datetime.fromtimestamp(t, datetime.timezone.utc).strftime("%Y-%m-%d")
    numbers = lambda df: sorted(r.n for r in df.collect())
    assert days_of(first) == since and numbers(read(seen("v"), since)) == held({"p1", "p2"}, True) == numbers(read(["p1", "p2"], since))
    assert numbers(read(seen("v"))) == held({"p1", "p2"}, False) and -3 in numbers(read(["p1"]))
    assert numbers(read(seen("w"))) == [-2, -1] == numbers(read(["unknown"]))
    assert read(seen("all")).count() == read(None).count() == 3003 and read(seen("none")).count() == read([]).count() == 0
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("\n")[0]
    by_grants, by_list = plan(read(seen("v"), since)), plan(read(["p1", "p2"], since))
    assert "dynamicpruning" in by_grants and f"(_day#" in by_grants and since in by_grants
    assert "_part#" in by_list and "dynamicpruning" not in by_list
    # The scan that ran opened the parts of two subjects and the days of the look-back.
    parts = {r[0] for r in spark.createDataFrame([("p1",), ("p2",)], "s string").select(days.part_of(F.col("s"), 8)).collect()}
    files = {f for f in rows_files(path) if "__HIVE" not in f and any(f"_part={p}/" in f for p in parts) and f.split("_day=")[1][:10] >= since}
    ran = read(seen("v"), since)
    ran.collect()
    scan = scans(ran)[0]
    assert scan.metrics().apply("numFiles").value() == len(files) < len(rows_files(path)) / 3


def rows_files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def scans(df):
    """The file scans of a plan that has run."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            found.append(node)
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return [n for n in found if n.metrics().contains("numFiles") and "_day" in n.toString()]


def test_sensors_without_a_table_land_count_and_deduplicate(spark, tmp_path):
    root = tmp_path / "landing"
    fine = lambda uuid: json.dumps({"session_uuid": uuid, "started_at": 1.0, "rop_files": []})
    texts = {
        "a": ("u1", "timestamp_ns,x,y\n1,0.5,7\n2,1e3,\n2,1e3,\n", '{"timestamp_ns": 5, "interval_ms": 812, "ok": "yes"}\n'),
        "a-again": ("u1", "y, timestamp_ns, x\n7,1,0.5\n,2,1e3\n9,3,9007199254740993\n", '{"ok": "yes", "interval_ms": 812, "timestamp_ns": 5}\n\nbroken\n'),
        "b": ("u2", "timestamp_ns,z\n1,4\nsoon,5\n", '{"interval_ms": 1}\n'),
    }
    for name, (uuid, mag, ppi) in texts.items():
        (root / name).mkdir(parents=True)
        (root / name / "manifest.json").write_text(fine(uuid))
        (root / name / "mag.csv").write_text(mag)
        (root / name / "ppi.json").write_text(ppi)
    out = ingest.convert_bundles(spark, str(root), "csv", ("mag",))
    got = sorted((r.session_id, r.sensor, r.timestamp_ns, [(f.name, f.value, f.text) for f in r.fields]) for r in out["mag"].collect())
    ids = {r.session_uuid: r.id for r in out["sessions"].collect()}
    assert got == sorted([
        (ids["u1"], "mag", 1, [("x", 0.5, "0.5"), ("y", 7.0, "7")]), (ids["u1"], "mag", 2, [("x", 1000.0, "1e3")]),
        (ids["u1"], "mag", 3, [("x", 9007199254740992.0, "9007199254740993"), ("y", 9.0, "9")]), (ids["u2"], "mag", 1, [("z", 4.0, "4")]),
    ])
    assert {r.sensor: r.duplicates for r in out["duplicates"].collect()}["mag"] == 3 and out["broken_mag"].count() == 1
    stats = {r.session_uuid: r.samples_per_sensor for r in out["stats"].collect()}
    assert stats == {"u1": {"mag": 3}, "u2": {"mag": 1}}
    again = ingest.convert_bundles(spark, str(root), "csv", ("mag",), stored={"mag": out["mag"]})
    assert again["mag"].count() == 0
    ppi = ingest.convert_bundles(spark, str(root), "json", ("ppi", "never"))
    assert [(r.timestamp_ns, [f.name for f in r.fields]) for r in ppi["ppi"].collect()] == [(5, ["interval_ms", "ok"])]
    assert ppi["ppi"].select(bundles.field("interval_ms")).first()[0] == 812.0 and ppi["broken_ppi"].count() == 2 and ppi["never"].count() == 0


def test_samples_in_folders_of_part_files_keep_their_bundle(spark, tmp_path):
    root = tmp_path / "landing"
    rows = spark.createDataFrame([(1, 1, 2, 3), (2, 1, 2, 3)], "timestamp_ns long, x int, y int, z int")
    rows.write.parquet(str(root / "rec-1" / "acc.parquet"))
    assert {r.bundle for r in bundles.read_samples(spark, str(root), "acc").collect()} == {"rec-1"}


def test_lines_that_are_no_readings_are_set_apart(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "b.json").write_text(json.dumps(wire("a")) + "\n{broken\n\n[1]\n")
    path = str(tmp_path / "r")
    assert [r.reading_id for r in bundles.read_readings(spark, path, F.lit("p"), 1.0).collect()] == ["a"]
    assert bundles.corrupt_readings(spark, path).count() == 2


def test_a_batch_of_files_says_nothing_of_those_still_to_come(spark):
    files = spark.createDataFrame([("u", "a.rop", b"x")], "upload string, name string, content binary")
    declared = spark.createDataFrame([("u", "a.rop", hashlib.sha256(b"x").hexdigest()), ("u", "b.rop", "00")], "upload string, name string, sha256 string")
    verdicts = lambda **k: {r.name: r.verdict for r in bundles.check_files(files, declared, **k).collect()}
    assert verdicts() == {"a.rop": "ok", "b.rop": "missing"} and verdicts(missing=False) == {"a.rop": "ok"}
    assert bundles.check_files(files).first().verdict == "undeclared"


def test_ages_are_asked_for_at_any_time(spark):
    latest = spark.createDataFrame([("p", 100.0)], "subject_id string, last_ts double")
    assert [streams.aged(latest, now, 50).first().stale for now in (120.0, 151.0)] == [False, True]


def test_one_recording_reads_its_bucket_only(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id % 50 session_id", "id timestamp_ns", "1 ppg0", "1 ppg1", "1 ppg2", "0 ambient")
    bundles.write_samples(rows, str(tmp_path / "s"), buckets=8)
    found = bundles.read_bucketed(spark, str(tmp_path / "s"), 7, buckets=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 40 and "EqualTo(session_id,7)" in plan and "session_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_look_back_reaches_the_files(spark, tmp_path):
    from wavecohort.operators.collection import place_readings
    from wavecohort.operators.trends import reading_points

    spark.createDataFrame([], schema_of("cuff_readings")).write.parquet(str(tmp_path / "r"))
    stored_rows = spark.read.schema(schema_of("cuff_readings")).parquet(str(tmp_path / "r"))
    plan = reading_points(place_readings(stored_rows, "Europe/Stockholm"), 1.77e9, 30)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(taken_at," in plan


def test_a_batch_of_a_stream_is_landed_as_a_fixed_number_of_files(spark, tmp_path):
    parts = [spark.range(1000).coalesce(2), spark.range(5000, 5002), spark.range(0)]
    stream, seen = storing.land_batches(spark, parts, str(tmp_path / "in"), 4), []
    streams.each_batch(stream, str(tmp_path / "state"), lambda b, n: seen.append(sorted(r.id for r in b.collect()))).awaitTermination()
    assert seen == [list(range(1000)), [5000, 5001], []]
    assert max(spark.read.parquet(f).count() for f in glob.glob(f"{tmp_path}/in/*.parquet")) <= 300


@pytest.mark.parametrize("name, landed", [("k6_file_stream", ["files"]), ("k6_file_verdicts", ["sent", "said"])])
def test_files_are_landed_by_many_tasks(spark, tmp_path, monkeypatch, name, landed):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(session, "PARTITION_BYTES", session._size(spark, str(tmp_path)) // 4)
    monkeypatch.setattr(storing, "folder", lambda spark, name: str(tmp_path / name))
    assert storing.QUERIES[name](spark, str(tmp_path)).count() > 400
    for folder in landed:
        sizes = [spark.read.parquet(f).count() for f in glob.glob(f"{tmp_path}/{folder}/*.parquet")]
        assert len(sizes) >= 12 and max(sizes) <= 100
