"""Clocks, scopes, pairing outcomes, projections and rules on hand-made rows."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from wavecohort.functions import clock, text, values
from wavecohort.operators import collection as c, rules, scope
from wavecohort.plans.series import Series
from wavecohort.plans.status import CollectionStatus
from wavecohort.schemas import DDL, schema_of

NOW = 1_769_000_000.0
HOUR, DAY = 3600.0, 86400.0


def wall(epoch):
    return datetime.fromtimestamp(epoch, tz=timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")


def table(spark, name, rows):
    names = schema_of(name).names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema_of(name))


def reading(rid, epoch, who="p", **more):
    base = dict(reading_id=rid, taken_at=wall(epoch), sys=120, dia=80, pulse=60, uploader_phone_id=who,
                uploaded_at=NOW - HOUR, clock_offset_s=0.0, clock_valid=True, clock_suspect=False)
    return {**base, **more}


def store(spark, **rows):
    return {name: table(spark, name, rows.get(name, [])) for name in DDL}


@pytest.mark.parametrize(
    "zone, wall_time, later, earlier",
    [
        ("Europe/Stockholm", "2026-10-25T02:30:00", 1792891800, 1792888200),  # repeated hour
        ("Europe/Stockholm", "2026-03-29T02:30:00", 1774747800, 1774747800),  # skipped hour
        ("Europe/Stockholm", "2026-07-01T12:00:00", 1782900000, 1782900000),
        ("America/New_York", "2026-11-01T01:15:00", 1793513700, 1793510100),
        ("Australia/Lord_Howe", "2026-04-05T01:45:00", 1775315700, 1775313900),  # half-hour change
        ("UTC", "2026-10-25T02:30:00", 1792895400, 1792895400),
    ],
)
def test_wall_time_in_changing_hours(spark, zone, wall_time, later, earlier):
    df = spark.createDataFrame([(wall_time,)], "w string")
    row = df.select(
        clock.wall_epoch(F.col("w"), zone).alias("later"),
        clock.wall_epoch(F.col("w"), zone, "earlier").alias("earlier"),
    ).first()
    assert (row.later, row.earlier) == (later, earlier)


def test_malformed_wall_time_fails_or_is_split(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00",), ("yesterday",)], "w string")
    with pytest.raises(Exception, match="yesterday"):
        df.select(clock.wall_epoch(F.col("w"), "UTC")).collect()
    rows = df.select(clock.wall_epoch(F.col("w"), "UTC", on_error="null").alias("e")).collect()
    assert [r.e is None for r in rows] == [False, True]


def test_every_reading_has_one_outcome_and_a_reason(spark):
    t = store(
        spark,
        uploads=[dict(phone_session_uuid="u1", uploader_phone_id="p", status="complete")],
        sessions=[dict(id=1, session_uuid="u1", start_time=NOW - HOUR, end_time=NOW - HOUR / 2)],
        cuff_readings=[
            reading("a", NOW - HOUR + 600),
            reading("b", NOW - HOUR - 10_500),
            reading("c", NOW - HOUR, clock_offset_s=None),
            reading("d", NOW - HOUR, clock_valid=False),
            reading("e", NOW - HOUR, clock_suspect=True),
        ],
    )
    row = CollectionStatus(t, NOW, "UTC").subjects.first()
    assert (row.pairs, row.unpaired_no_overlap, row.unpaired_clock_never_read) == (1, 1, 1)
    assert (row.unpaired_clock_invalid, row.unpaired_clock_suspect) == (1, 1)
    assert 10_000 < row.nearest_miss_s < 11_000


def test_offset_moves_a_reading_into_its_recording_and_others_do_not_count(spark):
    t = store(
        spark,
        uploads=[
            dict(phone_session_uuid="u1", uploader_phone_id="p", status="complete"),
            dict(phone_session_uuid="u2", uploader_phone_id="q", status="complete"),
        ],
        sessions=[dict(id=1, session_uuid="u1", start_time=NOW - HOUR, end_time=NOW - HOUR / 2)],
        cuff_readings=[
            reading("in", NOW + 5 * HOUR, clock_offset_s=5.75 * HOUR),
            reading("other", NOW - HOUR + 60, who="q"),
        ],
    )
    rows = {r.subject_id: r for r in CollectionStatus(t, NOW, "UTC").subjects.collect()}
    assert rows["p"].pairs == 1 and rows["q"].pairs == 0
    assert [r.session_id for r in Series(t, NOW, "UTC").pairs.collect()] == [1]


def test_missing_and_empty_uploaders_share_one_subject(spark):
    t = store(spark, cuff_readings=[reading("a", NOW, who=None), reading("b", NOW, who="")])
    rows = CollectionStatus(t, NOW, "UTC").subjects.collect()
    assert [(r.subject_id, r.cuff_readings) for r in rows] == [("unknown", 2)]


def test_empty_store_has_no_rows_and_no_failures(spark):
    t = store(spark)
    status = CollectionStatus(t, NOW, "UTC")
    assert status.subjects.count() == 0 and status.warnings.count() == 0
    assert {r.row_count for r in status.totals.collect()} == {0}
    assert status.uploads_pending.first().total_incomplete == 0
    assert Series(t, NOW, "UTC").pairs.count() == 0 and Series(t, NOW, "UTC").coverage.count() == 0


@pytest.mark.parametrize("wanted, seen", [(None, {"p", "q"}), (["*"], {"p", "q"}), (["p"], {"p"}), ([], set())])
def test_scope_filters_every_block(spark, wanted, seen):
    t = store(
        spark,
        uploads=[dict(phone_session_uuid=f"u{k}", uploader_phone_id=k, status="open", opened_at=NOW - 60) for k in "pq"],
        sessions=[dict(id=n, session_uuid=f"u{k}", start_time=NOW - HOUR, end_time=NOW) for n, k in enumerate("pq")],
        cuff_readings=[reading(k, NOW - 60, who=k) for k in "pq"],
        notes=[dict(session_id=n, ts=NOW, note='{"event": "calibration_start", "name": "x"}') for n in (0, 1)],
        ppg=[dict(session_id=n, timestamp_ns=1, ppg0=1, ppg1=1, ppg2=1, ambient=0) for n in (0, 1)],
        derived_ppg_minute=[dict(ts=NOW, label="u", hr_ppg=60.0, sqi=0.9, acc_motion=0.0)],
    )
    status, series = CollectionStatus(t, NOW, "UTC", wanted), Series(t, NOW, "UTC", scope=wanted)
    assert {r.subject_id for r in status.subjects.collect()} == seen
    assert {r.subject_id for r in status.recent_sessions.collect()} == seen
    assert {r.subject_id for r in status.recent_cuff.collect()} == seen
    assert status.markers.count() == len(seen)
    totals = {r.table_name: r.row_count for r in status.totals.collect()}
    assert totals["sessions"] == totals["ppg"] == totals["cuff_readings"] == totals["notes"] == len(seen)
    assert status.uploads_pending.first().total_incomplete == len(seen)
    # Minutes carry no subject: only an unrestricted viewer sees them.
    assert status.quality.first().minutes == (1 if len(seen) == 2 else 0)
    assert series.quality.count() == (1 if len(seen) == 2 else 0)
    assert {r.subject_id for r in series.cuff.collect()} == seen


def test_scope_as_a_table_is_a_semi_join(spark):
    df = spark.createDataFrame([("p",), (None,), ("q",)], "uploader_phone_id string")
    wanted = spark.createDataFrame([("unknown",), ("q",)], "s string")
    assert scope.restrict(df, F.col("uploader_phone_id"), wanted).count() == 2


def test_grants(spark):
    rows = [("op", None), ("one", ["p"]), ("blank", [" ", "q"]), ("none", [])]
    got = scope.resolve_grants(spark.createDataFrame(rows, "viewer string, subjects array<string>"), "viewer", "subjects")
    assert {tuple(r) for r in got.collect()} == {("op", "*"), ("one", "p"), ("blank", "q")}


@pytest.mark.parametrize("rate, age, span, want", [(6.0, 20, 30.0, 120.0), (30.5, 4.85, 2.0, None), (None, 20, 30.0, None), (6.0, None, 30.0, None), (6.0, 20, 14.0, 120.0), (6.0, 20, 13.99, None)])
def test_projection_needs_a_long_look(spark, rate, age, span, want):
    df = spark.createDataFrame(
        [(rate, span, None if age is None else age * DAY)],
        "cuff_per_day double, cuff_rate_span_days double, last_cuff_transfer_age_s double",
    )
    assert c.unsynced_projection(df).first().estimated_unsynced_cuff == want


def state(spark, **more):
    base = dict(subject_id="p", sessions=5, recorded_hours=2.0, last_session_age_s=HOUR, cuff_readings=30,
                last_cuff_transfer_age_s=HOUR, cuff_per_day=6.0, cuff_rate_span_days=30.0,
                estimated_unsynced_cuff=1.0, pairs=25, unpaired_no_overlap=0, unpaired_clock_never_read=0,
                unpaired_clock_invalid=0, unpaired_clock_suspect=0, nearest_miss_s=None)
    row = {**base, **more}
    ddl = ("subject_id string, sessions long, recorded_hours double, last_session_age_s double, cuff_readings long, "
           "last_cuff_transfer_age_s double, cuff_per_day double, cuff_rate_span_days double, "
           "estimated_unsynced_cuff double, pairs long, unpaired_no_overlap long, unpaired_clock_never_read long, "
           "unpaired_clock_invalid long, unpaired_clock_suspect long, nearest_miss_s double")
    return spark.createDataFrame([tuple(row.values())], ddl)


@pytest.mark.parametrize(
    "facts, level, message, detail",
    [
        ({"last_session_age_s": None}, "warn", "No recordings yet", ""),
        ({"last_session_age_s": 3 * DAY}, "error", "No recording for 3 d", "Collection may have stopped."),
        ({"last_cuff_transfer_age_s": 15 * DAY}, "error", "Cuff not transferred for 15 d", "overwrites silently"),
        ({"estimated_unsynced_cuff": 100.0}, "error", "Cuff buffer estimated full", "~100 readings estimated"),
        ({"estimated_unsynced_cuff": 70.0}, "warn", "Cuff buffer filling", "Projected from 6/day observed over 30 d."),
        ({"pairs": 19}, "info", "19 of 20 calibration pairs", "30 mmHg"),
        ({"pairs": 0, "cuff_readings": 0}, "warn", "No calibration pairs", "No cuff readings yet."),
        ({"pairs": 0, "sessions": 0}, "warn", "No calibration pairs", "No recordings yet, so there is nothing"),
        ({"pairs": 0, "unpaired_clock_never_read": 4, "unpaired_no_overlap": 4}, "warn", "No calibration pairs", "4 readings have no cuff clock offset"),
        ({"pairs": 0, "unpaired_clock_never_read": 4, "unpaired_no_overlap": 100}, "warn", "No calibration pairs", "100 readings fall outside every recording."),
        ({"pairs": 0, "unpaired_clock_invalid": 2, "unpaired_clock_suspect": 3, "unpaired_no_overlap": 5}, "warn", "No calibration pairs", "5 readings have an untrustworthy cuff clock"),
        ({"pairs": 0, "unpaired_no_overlap": 3, "nearest_miss_s": 7230.0}, "warn", "No calibration pairs", "almost exactly 2 h"),
        ({"pairs": 0, "unpaired_no_overlap": 3, "nearest_miss_s": 600.0}, "warn", "No calibration pairs", "closest by 10 min"),
        ({"pairs": 0, "unpaired_no_overlap": 3, "nearest_miss_s": 5400.0}, "warn", "No calibration pairs", "closest by 1.5 h"),
        ({"pairs": 0, "unpaired_no_overlap": 3, "nearest_miss_s": 2.6 * DAY}, "warn", "No calibration pairs", "closest by 3 d"),
        ({"pairs": 0}, "warn", "No calibration pairs", "No cuff reading falls inside a recording."),
    ],
)
def test_subject_rules(spark, facts, level, message, detail):
    rows = rules.subject_warnings(state(spark, **facts)).collect()
    assert len(rows) == 1
    assert (rows[0].level, rows[0].message) == (level, message) and detail in rows[0].detail


def test_healthy_subject_is_silent(spark):
    assert rules.subject_warnings(state(spark)).count() == 0


def test_backlog_ages(spark):
    opened = [NOW - 60, NOW - 3 * HOUR, NOW - 40 * HOUR, None]
    rows = [dict(phone_session_uuid=str(n), status="open", opened_at=at) for n, at in enumerate(opened)]
    rows.append(dict(phone_session_uuid="done", status="complete", opened_at=NOW - 99 * HOUR))
    b = c.upload_backlog(table(spark, "uploads", rows), NOW).first()
    assert (b["count"], b.in_flight, b.abandoned, b.total_incomplete) == (3, 1, 1, 4)
    assert b.oldest_age_s == 3 * HOUR and b.oldest_incomplete_age_s == 40 * HOUR
    said = {r.rule: r.message for r in rules.backlog_warnings(c.upload_backlog(table(spark, "uploads", rows), NOW)).collect()}
    assert said == {11: "2 uploads never completed", 13: "1 upload never completed and is no longer being retried"}


def test_warnings_are_ranked(spark):
    both = rules.subject_warnings(state(spark, pairs=3, last_session_age_s=9 * DAY, last_cuff_transfer_age_s=99 * DAY))
    clocks = spark.createDataFrame([(5, 4, 2, 3, 1, 9.0)], "cuff_total long, with_provenance long, not_valid long, no_provenance long, suspect long, max_abs_offset_s double")
    got = [(r.level, r.rule) for r in rules.ranked(both.unionByName(rules.clock_warnings(clocks))).collect()]
    assert got == [("error", 2), ("error", 3), ("error", 8), ("warn", 10), ("info", 7), ("info", 9)]


def test_numbers_as_text(spark):
    shown = [(6.0, "6"), (30.5, "30.5"), (0.25, "0.25"), (100.0, "100"), (12345.67, "12345.7"), (123456.7, "123457"), (1234567.0, "1.23457e+06"), (0.0, "0")]
    df = spark.createDataFrame([(v,) for v, _ in shown], "v double")
    assert [r.t for r in df.select(text.shortest(F.col("v")).alias("t")).collect()] == [t for _, t in shown]
    ages = [(None, "never"), (89.0, "89 s ago"), (90.0, "2 min ago"), (5400.0, "2 h ago"), (172800.0, "2 d ago")]
    df = spark.createDataFrame([(v,) for v, _ in ages], "v double")
    assert [r.t for r in df.select(text.age_text(F.col("v")).alias("t")).collect()] == [t for _, t in ages]


def test_nan_minute_blanks_its_hour_and_is_not_usable(spark):
    nan = float("nan")
    rows = [dict(ts=NOW, label="a", hr_ppg=nan, sqi=nan, acc_motion=1.0), dict(ts=NOW + 1, label="a", hr_ppg=60.0, sqi=0.9, acc_motion=1.0)]
    minutes = table(spark, "derived_ppg_minute", rows)
    assert (c.usable_minutes(minutes).first().good_minutes, c.usable_minutes(minutes, nan_is_good=True).first().good_minutes) == (1, 2)
    from wavecohort.operators.trends import hourly_quality

    row = hourly_quality(minutes, NOW + 10).first()
    assert row.sqi is None and row.hr is None and row.motion == 1.0 and row.minutes == 2
    assert hourly_quality(minutes, NOW + 10, skip_nan=True).first().sqi == 0.9


def test_look_back_and_names(spark):
    df = spark.createDataFrame([(NOW - 5 * DAY,), (NOW + DAY,), (NOW - 1,)], "ts double")
    assert df.where(clock.since_days(F.col("ts"), NOW, 2)).count() == 2
    assert df.where(clock.since_days(F.col("ts"), NOW, 0)).count() == 3
    names = ["manifest.json", "a.rop", "../a.rop", "x/y.rop", "a..rop", ".rop", "notes.csv", "notes.txt", "ok-1_2.rop"]
    got = spark.createDataFrame([(n,) for n in names], "n string").where(values.allowed_name(F.col("n"))).collect()
    assert {r.n for r in got} == {"manifest.json", "a.rop", "notes.csv", "ok-1_2.rop"}


def test_a_scope_held_as_rows_means_the_same_as_a_list(spark):
    from pyspark.sql import functions as F

    from wavecohort.operators import scope

    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "subject string")
    kept = lambda s: rows.transform(lambda d: scope.restrict(d, F.col("subject"), s)).count()
    held = lambda *s: spark.createDataFrame([(x,) for x in s], "subject_id string")
    assert [kept(held("*")), kept(held("a", "*")), kept(held("a", "b")), kept(held())] == [3, 3, 2, 0]
    assert scope.unrestricted(held("*")) and not scope.unrestricted(held())
    grants = scope.resolve_grants(spark.createDataFrame([("v", None), ("w", ["a"]), ("x", [" "])], "viewer string, subjects array<string>"), "viewer", "subjects")
    assert [kept(scope.scope_of(grants, "viewer", v)) for v in "vwx"] == [3, 1, 0]


def test_many_readings_of_one_subject_are_all_summarised(spark):
    from wavecohort.operators import trends

    base = spark.range(6000).selectExpr("'s' subject_id", "cast(id as string) reading_id", "id * 600.0D ts", "100 + cast(id % 7 as int) sys", "80 dia", "60 pulse")
    assert trends.daily_summary(base, "UTC").agg({"n": "sum"}).first()[0] == 6000
    assert trends.run_summary(base, ["subject_id"], "ts", trends.READING_GAP_S).first().points == 6000
    assert trends.newest_points(base).count() == trends.MAX_POINTS
