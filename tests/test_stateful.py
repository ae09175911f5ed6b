"""Freshness by timers and pairing of two streams, over batches, restarts and expiry."""

import datetime
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from wavecohort.sources import buckets
from wavecohort.streaming import stateful

ROWS = "subject_id string, ts double"
READINGS = "reading_id string, subject_id string, t double"
RECORDINGS = "id bigint, subject_id string, start_time double, end_time double"


def arrive(spark, path, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(path))


def told(spark, root):
    return {r.subject_id: (r.last_ts, r.rows, r.stale) for r in stateful.fresh_subjects(spark, root).collect()}


def batches(spark, root):
    rows = buckets.unfolded(spark, root, stateful._fresh_schema(False)).collect()
    return {n: sorted(((r.subject_id, r.stale) for r in rows if r.batch == n), key=str) for n in {r.batch for r in rows}}


def test_a_silent_subject_turns_stale_as_others_go_on_and_after_a_restart(spark, tmp_path):
    source, root, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run(rows):
        arrive(spark, source, rows, ROWS)
        changes = stateful.freshness(spark.readStream.schema(ROWS).parquet(str(source)), 100, "10 seconds")
        stateful.keep_freshness(changes, root, state).awaitTermination()
        return told(spark, root)

    assert run([("a", 1000.0), ("b", 1050.0), ("b", None), (None, 1040.0)]) == {"a": (1000.0, 1, False), "b": (1050.0, 2, False), None: (1040.0, 1, False)}
    # Each run is a restart. The watermark reaches 1125: only a is silent for more than 100 s.
    assert run([("b", 1135.0)]) == {"a": (1000.0, 1, True), "b": (1135.0, 3, False), None: (1040.0, 1, False)}
    stateful.fold_freshness(spark, root)
    assert run([("c", 1300.0), ("b", 1126.0)]) == {"a": (1000.0, 1, True), "b": (1135.0, 4, True), "c": (1300.0, 1, False), None: (1040.0, 1, True)}
    # Told once, and only those that changed: a is in none of the batches since the fold.
    assert all(s != "a" for rows in batches(spark, root).values() for s, _ in rows)
    assert run([("a", 1310.0)])["a"] == (1310.0, 2, False)


def test_a_silent_subject_turns_stale_with_no_row_arriving_at_all(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    arrive(spark, source, [("a", time.time()), ("old", 5.0)], ROWS)
    changes = stateful.freshness(spark.readStream.schema(ROWS).parquet(str(source)), 6)
    running = stateful.keep_freshness(changes, root, str(tmp_path / "state"), {"processingTime": "1 second"})
    try:
        until = time.time() + 90
        while time.time() < until and not (buckets._listed(spark, f"{root}/log", "batch") and told(spark, root).get("a", (0, 0, False))[2]):
            time.sleep(1)
    finally:
        running.stop()
    assert running.exception() is None
    seen = batches(spark, root)
    firsts = [rows for _, rows in sorted(seen.items()) if rows]
    assert firsts[0] in ([("a", False), ("old", True)], [("a", True), ("old", True)]) and told(spark, root)["a"][2]
    assert len(firsts) <= 2


def run_pairs(spark, tmp_path, **options):
    left = spark.readStream.schema(READINGS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "readings"))
    right = spark.readStream.schema(RECORDINGS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "recordings"))
    running = stateful.keep_pairs(stateful.pair_streams(left, right, **options), str(tmp_path / "out"), str(tmp_path / "state"))
    running.awaitTermination()
    state = [p.get("numRowsTotal") for p in running.lastProgress["stateOperators"]]
    return {r.reading_id: (r.session_id, r.gap) for r in stateful.best_pairs(spark, str(tmp_path / "out")).collect()}, state


def test_recordings_before_after_and_never(spark, tmp_path):
    put = lambda name, rows: arrive(spark, tmp_path / name, rows, READINGS if name == "readings" else RECORDINGS)
    # The recording of "before" has come, that of "after" has not; "never" has none, "other" is another subject's.
    put("recordings", [(7, "p", 1000.0, 1100.0), (3, "p", 1050.0, 1060.0), (9, "p", 900.0, None)])
    put("readings", [("before", "p", 1055.0), ("edge", "p", 1220.0), ("far", "p", 1220.5), ("after", "p", 5000.0), ("never", "q", 1055.0), ("gone", None, 1000.0), ("timeless", "p", None)])
    first, _ = run_pairs(spark, tmp_path, late="2 hours", piece_s=600)
    assert first == {"before": (3, 0.0), "edge": (7, 120.0)}
    put("recordings", [(1, "p", 4000.0, 4990.0), (2, "p", 1.0, 20_000.0), (4, "p", None, 9e9)])
    put("readings", [("again", "p", 5050.0)])
    second, _ = run_pairs(spark, tmp_path, late="2 hours", piece_s=600)
    # A long recording enters as pieces; it holds these readings, a gap of zero goes before a smaller id.
    assert {k: second[k][0] for k in ("before", "edge", "after", "again", "far")} == {"before": 2, "edge": 2, "after": 2, "again": 2, "far": 2}
    stateful.fold_pairs(spark, str(tmp_path / "out"))
    put("recordings", [(5, "z", 60_000.0, 60_001.0)])
    put("readings", [("late one", "z", 60_000.0)])
    third, state = run_pairs(spark, tmp_path, late="2 hours", piece_s=600)
    assert third["late one"] == (5, 0.0) and third["never"] == (None, None) and third["gone"] == (None, None) and "timeless" not in third
    assert third["before"] == (2, 0.0) and max(state) <= 4  # what the watermark passed is no longer held


@pytest.mark.parametrize("seed", [1])
def test_equals_all_pairs(spark, tmp_path, seed):
    t = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(20_000)).cast("double")
    subject = F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))
    readings = spark.range(300).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("reading_id"), subject.alias("subject_id"), t.alias("t"))
    start = F.pmod(F.xxhash64(F.lit(seed + 9), "id"), F.lit(20_000)).cast("double")
    spans = spark.range(200).select("id", subject.alias("subject_id"), start.alias("start_time"), (start + F.col("id") % 50 * 40).alias("end_time"))
    for name, rows, order in (("readings", readings, "t"), ("recordings", spans, "start_time")):
        for low, high in ((0, 7000), (7000, 14_000), (14_000, 1 << 40)):
            rows.where((F.col(order) >= low) & (F.col(order) < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    got, _ = run_pairs(spark, tmp_path, late="3 hours", piece_s=500)
    want = {}
    spans = spans.collect()
    for r in readings.collect():
        gaps = sorted((max(s.start_time - r.t, r.t - s.end_time, 0.0), s.id) for s in spans if s.subject_id == r.subject_id)
        if gaps[0][0] <= 120:
            want[r.reading_id] = gaps[0][::-1]
    assert {k: v for k, v in got.items() if v[0] is not None} == want


def test_a_crowded_subject_is_told_once_per_reading_not_per_pair(spark, tmp_path):
    arrive(spark, tmp_path / "recordings", [(n, "p", 1000.0 + n, 3000.0 - n) for n in range(300)], RECORDINGS)
    arrive(spark, tmp_path / "readings", [(f"r{n}", "p", 1400.0 + n) for n in range(400)], READINGS)
    got, _ = run_pairs(spark, tmp_path)
    assert set(got.values()) == {(0, 0.0)} and len(got) == 400
    assert buckets.unfolded(spark, str(tmp_path / "out"), stateful.StructType.fromDDL(stateful.PAIRED_DDL)).count() == 400


def test_the_sweep_equals_all_pairs_with_ties():
    draw = random.Random(3)
    for _ in range(200):
        times = [float(draw.randrange(60)) for _ in range(draw.randrange(12))]
        spans = [(n, s, s + draw.choice([0, 0, 1, 5, 30])) for n in range(draw.randrange(9)) for s in [float(draw.randrange(60))]]
        want = [min(((max(s - t, t - e, 0.0), n) for n, s, e in spans if s - 4 <= t <= e + 4), default=None) for t in times]
        assert stateful._sweep(4.0)(times, spans) == want


def test_a_file_sent_twice_is_told_once_and_one_that_never_comes_is_missing_once(spark, tmp_path):
    root = str(tmp_path / "out")
    sha = {c: hashlib.sha256(c.encode()).hexdigest() for c in "xyz"}
    files, said = "upload string, name string, content binary, at timestamp", "upload string, name string, sha256 string, at timestamp"
    stamp = lambda s: datetime.datetime.fromtimestamp(s, datetime.timezone.utc)

    def run(sent, declared):
        arrive(spark, tmp_path / "files", [("u", n, c.encode(), stamp(t)) for n, c, t in sent], files)
        arrive(spark, tmp_path / "said", [("u", n, h, stamp(t)) for n, h, t in declared], said)
        both = [spark.readStream.schema(d).parquet(str(tmp_path / p)) for d, p in ((files, "files"), (said, "said"))]
        stateful.keep_verdicts(stateful.file_verdicts(*both, 100, "10 seconds", 300), root, str(tmp_path / "state")).awaitTermination()
        rows = buckets.unfolded(spark, root, stateful.StructType.fromDDL(stateful.VERDICT_DDL)).collect()
        last = max(r.batch for r in rows)
        return {r.name: r.verdict for r in stateful.current_verdicts(spark, root).collect()}, rows, last

    first, _, _ = run([("a.rop", "x", 1000), ("a.rop", "x", 1001), ("free.rop", "y", 1000), ("bad name", "y", 1000), ("e.rop", "", 1000)], [("a.rop", sha["x"], 990), ("b.rop", sha["y"], 1000), ("c.rop", sha["z"], 1000)])
    assert first == {"a.rop": "ok", "free.rop": "undeclared", "bad name": "illegal_name", "e.rop": "empty"}
    # The same file again and a late declaration; the watermark passes the deadline of b and c.
    second, rows, last = run([("a.rop", "x", 1120)], [("free.rop", sha["z"], 1115)])
    assert second == first | {"free.rop": "mismatch", "b.rop": "missing", "c.rop": "missing"}
    third, rows, _ = run([("b.rop", "y", 1130), ("free.rop", "z", 1130)], [("d.rop", sha["x"], 1130)])
    assert third == second | {"b.rop": "ok", "free.rop": "ok"}
    assert sorted((r.name, r.verdict) for r in rows) == sorted([
        ("a.rop", "ok"), ("free.rop", "undeclared"), ("bad name", "illegal_name"), ("e.rop", "empty"),
        ("free.rop", "mismatch"), ("b.rop", "missing"), ("c.rop", "missing"), ("b.rop", "ok"), ("free.rop", "ok"),
    ])
    stateful.fold_verdicts(spark, root)
    # Long after, what was known of the file is forgotten, so the same file is told anew.
    assert run([("far.rop", "x", 9000)], [])[0]["d.rop"] == "missing"
    _, rows, last = run([("a.rop", "x", 9001)], [])
    assert [(r.name, r.verdict) for r in rows if r.batch == last and r.name == "a.rop"] == [("a.rop", "undeclared")]


def run_slices(spark, tmp_path, rows, gap, width, late="30 seconds"):
    """Runs after one more batch of rows; each call is a restart."""
    arrive(spark, tmp_path / "in", rows, ROWS)
    runs = stateful.sliced_runs(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), ("subject_id",), gap, width, late)
    running = runs.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    running.awaitTermination()
    assert running.exception() is None
    state = {o["operatorName"]: o["numRowsTotal"] for o in running.lastProgress["stateOperators"]} if running.lastProgress["stateOperators"] else {}
    out = spark.read.schema(runs.schema).parquet(str(tmp_path / "out")).collect()
    return sorted(((r.subject_id, r.first_ts, r.last_ts, r.points) for r in out), key=str), state


def looped_runs(rows, gap):
    want, by = [], {}
    for k, t in rows:
        by.setdefault(k, []).append(t)
    for k, times in by.items():
        times.sort()
        cuts = [0, *[i for i in range(1, len(times)) if times[i] - times[i - 1] > gap], len(times)]
        want += [(k, times[a], times[b - 1], b - a) for a, b in zip(cuts, cuts[1:])]
    return sorted(want, key=str)


@pytest.mark.parametrize("width", [60, 7])
def test_runs_of_one_hot_subject_equal_a_loop(spark, tmp_path, width):
    draw, times, t = random.Random(width), [], 500.0
    for _ in range(1500):
        t += draw.choice([0, 1, 1, 5, 10, 10, 10.5, 40, 200])
        times.append(t)
    rows = [("hot", x) for x in times] + [("b", x) for x in times[::50]] + [(None, times[5])]
    for part in range(3):
        low, high = times[500 * part], times[500 * part + 500] if part < 2 else float("inf")
        sent = [r for r in rows if (low <= r[1] or not part) and r[1] < high]
        draw.shuffle(sent)
        # The last batch brings a tick of another subject that lets the watermark pass all runs.
        got, state = run_slices(spark, tmp_path, sent + ([("tick", t + 1000), ("b", None)] if part == 2 else []), 10, width)
    assert got == looped_runs(rows, 10)
    assert sum(state.values()) <= 2  # what is final is no longer held


def test_a_run_is_stitched_at_borders_and_told_once_final(spark, tmp_path):
    # Slices of 100 s. A step of exactly the gap over a border joins, one microsecond more does not; a run may
    # cross several borders; what ends within its slice is told as soon as the watermark has passed the gap.
    first = [("x", 95.0), ("x", 105.0), ("y", 195.0), ("y", 205.000001), ("in", 150.0), ("in", 151.0)] + [("long", float(s)) for s in range(90, 420, 10)]
    got, _ = run_slices(spark, tmp_path, first + [("tick", 230.0)], 10, 100, "0 seconds")
    assert ("in", 150.0, 151.0, 2) in got and not any(r[0] == "long" for r in got)
    got, _ = run_slices(spark, tmp_path, [("tick", 260.0), ("tick", 2000.0)], 10, 100, "0 seconds")
    want = looped_runs(first, 10)
    assert [r for r in got if r[0] != "tick"] == want and ("x", 95.0, 105.0, 2) in want and len([r for r in want if r[0] == "y"]) == 2
    # What comes after a run was told, far behind the watermark, is dropped and tells nothing twice.
    again, _ = run_slices(spark, tmp_path, [("x", 100.0), ("tick", 3000.0)], 10, 100, "0 seconds")
    assert [r for r in again if r[0] != "tick"] == want
