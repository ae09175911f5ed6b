"""Ranked warnings, as pure functions of aggregates.

Each rule yields one nullable struct; the structs of a row are gathered in an array, the
ones that did not fire are dropped and the rest become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wavecohort.functions import text

# Thresholds.
RING_SLOTS = 100
FILL_WARN = 0.70
RECORDING_STALE_S = 48 * 3600
TRANSFER_STALE_S = 14 * 24 * 3600
GOOD_SHARE_WARN = 0.70
PAIR_TARGET = 20

# Message texts, with %s for what is filled in.
NO_RECORDINGS = "No recordings yet"
NO_RECORDING_FOR = "No recording for %s"
COLLECTION_STOPPED = "Collection may have stopped."
NOT_TRANSFERRED = "Cuff not transferred for %s"
OVERWRITES = f"The cuff holds {RING_SLOTS} readings and then overwrites silently."
BUFFER_FULL = "Cuff buffer estimated full"
BUFFER_FULL_WHY = (
    f"~%s readings estimated since the last transfer, ring holds {RING_SLOTS}. If the rate held, "
    "the oldest readings have already been overwritten.%s"
)
BUFFER_FILLING = "Cuff buffer filling"
BUFFER_FILLING_WHY = f"~%s of {RING_SLOTS} slots estimated used since the last transfer.%s"
BASIS = " Projected from %s/day observed over %s d."
NO_PAIRS = "No calibration pairs"
SOME_PAIRS = f"%s of {PAIR_TARGET} calibration pairs"
PAIRS_WANTED = f"Protocol target is at least {PAIR_TARGET} pairs spanning 30 mmHg."
BAD_CLOCKS = "%s cuff readings have an untrustworthy clock"
BAD_CLOCKS_WHY = "These cannot be paired with PPG."
OLD_CLOCKS = "%s cuff readings predate clock provenance"
OLD_CLOCKS_WHY = (
    "Recorded before the phone measured the cuff's clock, and already overwritten in the "
    "cuff, so they cannot be repaired. Not pairable."
)
QUARANTINED = "%s cuff readings quarantined on the phone"
STALLED = "%s uploads never completed"
STALLED_WHY = "The bundle reached the server but was not converted."
ONE_IN_FLIGHT = "%s upload in progress"
IN_FLIGHT = "%s uploads in progress"
IN_FLIGHT_WHY = "Started recently and still transferring."
ONE_ABANDONED = "%s upload never completed and is no longer being retried"
ABANDONED = "%s uploads never completed and are no longer being retried"
ABANDONED_WHY = (
    "The phone still holds the recording; it re-queues unsynced bundles the next time "
    "the app is opened."
)
LOW_SHARE = "Only %s of PPG minutes are usable"
LOW_SHARE_WHY = "Check sensor placement and skin contact."
WHY_NO_READINGS = "No cuff readings yet."
WHY_NO_RECORDINGS = "No recordings yet, so there is nothing for a reading to fall inside."
WHY_NEVER_READ = (
    "%s readings have no cuff clock offset. Run a cuff sync so the offset is measured, "
    "otherwise nothing can be paired."
)
WHY_BAD_CLOCK = (
    "%s readings have an untrustworthy cuff clock, so their time cannot be trusted "
    "against a recording."
)
WHY_NONE_INSIDE = "No cuff reading falls inside a recording."
WHY_OUTSIDE = "%s readings fall outside every recording"
WHY_ZONE = (
    ", the closest by almost exactly %s h. That is a clock or timezone fault, not mistimed "
    "measurements."
)
WHY_CLOSE = ", the closest by %s min. Take the cuff reading while the recording is running."
WHY_FAR = ", the closest by %s. Record and measure at the same time."

LEVEL_RANK = {"error": 0, "warn": 1, "info": 2}


def _say(template: str, *values: Column) -> Column:
    return F.format_string(template, *[v.cast("string") for v in values]) if values else F.lit(template)


def _rule(number: int, level: str, when: Column, message: Column, detail: Column | None = None) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(number).alias("rule"),
            F.lit(level).alias("level"),
            F.lit(LEVEL_RANK[level]).alias("rank"),
            message.alias("message"),
            (F.lit("") if detail is None else detail).alias("detail"),
        ),
    )


def _fired(df: DataFrame, subject: Column, rules: list[Column]) -> DataFrame:
    hits = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return df.select(subject.alias("subject_id"), F.explode(hits).alias("r")).select("subject_id", "r.*")


def why_no_pairs() -> Column:
    """The most likely cause of zero pairs: the largest group, clock faults winning a tie."""
    never = F.col("unpaired_clock_never_read")
    bad = F.col("unpaired_clock_invalid") + F.col("unpaired_clock_suspect")
    outside = F.col("unpaired_no_overlap")
    miss = F.col("nearest_miss_s")
    hours = F.bround(miss / 3600.0, 0)
    lead = _say(WHY_OUTSIDE, outside)
    zone_fault = (miss >= 3540) & (F.abs(miss - hours * 3600.0) < 120)
    far = F.when(miss >= 86400, text.days_or_hours(miss)).otherwise(
        F.concat(text.one_decimal(miss / 3600.0), F.lit(" h"))
    )
    return (
        F.when(F.col("cuff_readings") == 0, WHY_NO_READINGS)
        .when(F.col("sessions") == 0, WHY_NO_RECORDINGS)
        .when((never > 0) & (never >= outside), _say(WHY_NEVER_READ, never))
        .when((bad > 0) & (bad >= outside), _say(WHY_BAD_CLOCK, bad))
        .when(outside == 0, WHY_NONE_INSIDE)
        .when(miss.isNull(), F.concat(lead, F.lit(".")))
        .when(zone_fault, F.concat(lead, _say(WHY_ZONE, hours.cast("bigint"))))
        .when(miss / 60.0 < 30, F.concat(lead, _say(WHY_CLOSE, text.whole(miss / 60.0))))
        .otherwise(F.concat(lead, _say(WHY_FAR, far)))
    )


def subject_warnings(state: DataFrame) -> DataFrame:
    age, sent = F.col("last_session_age_s"), F.col("last_cuff_transfer_age_s")
    est, rate, span = F.col("estimated_unsynced_cuff"), F.col("cuff_per_day"), F.col("cuff_rate_span_days")
    pairs = F.col("pairs")
    known = rate.isNotNull() & span.isNotNull()
    basis = F.when(known, _say(BASIS, text.shortest(rate), text.shortest(span))).otherwise("")
    return _fired(
        state,
        F.col("subject_id"),
        [
            _rule(1, "warn", age.isNull(), _say(NO_RECORDINGS)),
            _rule(
                2, "error", age > RECORDING_STALE_S,
                _say(NO_RECORDING_FOR, text.days_or_hours(age)), _say(COLLECTION_STOPPED),
            ),
            _rule(
                3, "error", sent > TRANSFER_STALE_S,
                _say(NOT_TRANSFERRED, text.days_or_hours(sent)), _say(OVERWRITES),
            ),
            _rule(4, "error", est >= RING_SLOTS, _say(BUFFER_FULL), _say(BUFFER_FULL_WHY, text.shortest(est), basis)),
            _rule(
                5, "warn", (est >= RING_SLOTS * FILL_WARN) & (est < RING_SLOTS),
                _say(BUFFER_FILLING), _say(BUFFER_FILLING_WHY, text.shortest(est), basis),
            ),
            _rule(6, "warn", pairs == 0, _say(NO_PAIRS), why_no_pairs()),
            _rule(7, "info", (pairs > 0) & (pairs < PAIR_TARGET), _say(SOME_PAIRS, pairs), _say(PAIRS_WANTED)),
        ],
    )


def clock_warnings(clock: DataFrame) -> DataFrame:
    bad, old, held = F.col("not_valid"), F.col("no_provenance"), F.col("suspect")
    return _fired(
        clock,
        F.lit(None).cast("string"),
        [
            _rule(8, "error", bad > 0, _say(BAD_CLOCKS, bad), _say(BAD_CLOCKS_WHY)),
            _rule(9, "info", old > 0, _say(OLD_CLOCKS, old), _say(OLD_CLOCKS_WHY)),
            _rule(10, "warn", held > 0, _say(QUARANTINED, held)),
        ],
    )


def backlog_warnings(backlog: DataFrame) -> DataFrame:
    flying, gone = F.col("in_flight"), F.col("abandoned")
    stalled = F.col("count") - flying
    one_or_more = lambda n, one, more: F.when(n == 1, _say(one, n)).otherwise(_say(more, n))
    return _fired(
        backlog,
        F.lit(None).cast("string"),
        [
            _rule(11, "error", stalled > 0, _say(STALLED, stalled), _say(STALLED_WHY)),
            _rule(
                12, "info", (stalled <= 0) & (flying > 0),
                one_or_more(flying, ONE_IN_FLIGHT, IN_FLIGHT), _say(IN_FLIGHT_WHY),
            ),
            _rule(13, "warn", gone > 0, one_or_more(gone, ONE_ABANDONED, ABANDONED), _say(ABANDONED_WHY)),
        ],
    )


def quality_warnings(quality: DataFrame) -> DataFrame:
    share = F.try_divide(F.col("good_minutes"), F.col("minutes"))
    return _fired(
        quality,
        F.lit(None).cast("string"),
        [_rule(14, "warn", share < GOOD_SHARE_WARN, _say(LOW_SHARE, text.percent(share)), _say(LOW_SHARE_WHY))],
    )


def all_warnings(state: DataFrame, clock: DataFrame, backlog: DataFrame, quality: DataFrame) -> DataFrame:
    return (
        subject_warnings(state)
        .unionByName(clock_warnings(clock))
        .unionByName(backlog_warnings(backlog))
        .unionByName(quality_warnings(quality))
    )


def ranked(warnings: DataFrame) -> DataFrame:
    """Errors first; within a level subjects by name, then the store as a whole, in rule order."""
    return warnings.orderBy("rank", F.asc_nulls_last("subject_id"), "rule")


def tile_states(state: DataFrame) -> DataFrame:
    """State of the four figures shown per subject, with their texts."""
    age, sent = F.col("last_session_age_s"), F.col("last_cuff_transfer_age_s")
    est, pairs = F.col("estimated_unsynced_cuff"), F.col("pairs")
    dated = lambda c, limit: F.when(c.isNull(), "warn").when(c > limit, "error").otherwise("ok")
    return state.select(
        "subject_id",
        dated(age, RECORDING_STALE_S).alias("recording_state"),
        text.age_text(age).alias("recording_text"),
        dated(sent, TRANSFER_STALE_S).alias("transfer_state"),
        text.age_text(sent).alias("transfer_text"),
        F.when(est.isNull(), "").when(est >= RING_SLOTS, "error").when(est >= RING_SLOTS * FILL_WARN, "warn").otherwise("ok").alias("buffer_state"),
        F.when(pairs == 0, "warn").when(pairs < PAIR_TARGET, "").otherwise("ok").alias("pairs_state"),
        text.unpaired_text(
            F.col("unpaired_no_overlap"),
            F.col("unpaired_clock_never_read"),
            F.col("unpaired_clock_invalid"),
            F.col("unpaired_clock_suspect"),
            F.col("nearest_miss_s"),
        ).alias("unpaired_text"),
    )
