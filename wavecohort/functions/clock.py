"""Wall clocks, epochs, clock trust and time windows.

Two clocks meet in this data: a reading carries the local wall time of its own device,
everything else is epoch seconds. Wall time is always converted through a named zone.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

DAY_S = 86400.0


def wall_to_instant(wall: Column, tz: str, ambiguous: str = "later", on_error: str = "fail") -> Column:
    """ISO local wall time to a timestamp (the session zone must be UTC).

    In the repeated hour of a clock change two instants share one wall time;
    ``ambiguous`` picks the ``later`` or the ``earlier``. Text that is no timestamp
    fails the query, or becomes null with ``on_error='null'`` so that it can be
    split off by the caller.
    """
    if ambiguous not in ("later", "earlier"):
        raise ValueError("ambiguous must be 'later' or 'earlier'")
    if on_error == "null":
        local = F.try_to_timestamp(wall)
    elif on_error == "fail":
        local = wall.cast("timestamp")
    else:
        raise ValueError("on_error must be 'fail' or 'null'")
    plain = F.to_utc_timestamp(local, tz)
    if ambiguous == "earlier":
        return plain
    # The zone offset one day on is the one after the change; it names the later instant
    # whenever that instant shows the same wall time.
    day = F.expr("interval 24 hours")
    offset_us = F.unix_micros(local + day) - F.unix_micros(F.to_utc_timestamp(local + day, tz))
    later = F.timestamp_micros(F.unix_micros(local) - offset_us)
    return F.when(F.from_utc_timestamp(later, tz) == local, later).otherwise(plain)


def epoch_s(instant: Column) -> Column:
    return F.unix_micros(instant) / F.lit(1e6)


def wall_epoch(wall: Column, tz: str, ambiguous: str = "later", on_error: str = "fail") -> Column:
    """ISO local wall time to epoch seconds."""
    return epoch_s(wall_to_instant(wall, tz, ambiguous, on_error))


def corrected(epoch: Column, offset_s: Column) -> Column:
    """Remove the device-minus-phone clock offset; an unmeasured offset counts as zero."""
    return epoch - F.coalesce(offset_s, F.lit(0.0))


def clock_state(offset_s: Column, suspect: Column, valid: Column) -> Column:
    """``never_read``, ``suspect``, ``invalid`` or ``ok``, the first that applies."""
    return (
        F.when(offset_s.isNull(), "never_read")
        .when(flag(suspect), "suspect")
        .when(~flag(valid), "invalid")
        .otherwise("ok")
    )


def clock_trusted(offset_s: Column, suspect: Column, valid: Column, require_offset: bool = True) -> Column:
    """True where the clock may be used for matching.

    ``require_offset=False`` also trusts readings whose offset was never measured.
    """
    ok = flag(valid) & ~flag(suspect)
    return ok & offset_s.isNotNull() if require_offset else ok


def flag(column: Column) -> Column:
    """A nullable boolean with null meaning false."""
    return F.coalesce(column, F.lit(False))


def not_quarantined(suspect: Column) -> Column:
    return ~flag(suspect)


def span_s(start: Column, end: Column) -> Column:
    """Length of an interval; one with an open end has length zero."""
    return F.coalesce(end, start) - start


def closed_span_s(start: Column, end: Column) -> Column:
    """Length of an interval, null while either end is missing or zero."""
    return F.when((start != 0) & (end != 0), end - start)


def age_s(then: Column, now: float) -> Column:
    """Seconds since ``then``, never negative, null when it never happened."""
    return F.when(then.isNotNull(), F.greatest(F.lit(0.0), F.lit(float(now)) - then))


def since_days(epoch: Column, now: float, days: int | None) -> Column:
    """Lower bound of a trailing look-back; zero or None means unbounded."""
    if not days:
        return F.lit(True)
    return epoch >= F.lit(float(now) - int(days) * DAY_S)


def since_wall(wall: Column, epoch: Column, now: float, days: int | None) -> Column:
    """``since_days`` for rows that hold a wall time as text.

    The text is bounded too, two days wider than any zone can shift it, so that the bound
    reaches the files; text that is no ISO time sorts anywhere and is kept by the second test.
    """
    if not days:
        return F.lit(True)
    first = datetime.fromtimestamp(float(now) - (int(days) + 2) * DAY_S, timezone.utc).strftime("%Y-%m-%d")
    return (wall >= F.lit(first)) & since_days(epoch, now, days)


def local_instant(epoch: Column, tz: str) -> Column:
    """Epoch seconds as the wall time of a zone, held in a timestamp."""
    return F.from_utc_timestamp(F.timestamp_micros(F.round(epoch * 1e6).cast("bigint")), tz)


def local_day(epoch: Column, tz: str) -> Column:
    """Calendar day in a zone, as ``yyyy-MM-dd``."""
    return F.date_format(local_instant(epoch, tz), "yyyy-MM-dd")


def local_hour(epoch: Column, tz: str) -> Column:
    """Fractional hour of the local day, to the minute."""
    at = local_instant(epoch, tz)
    return F.hour(at) + F.minute(at) / F.lit(60.0)


def iso_utc(epoch: Column) -> Column:
    """Epoch seconds as ISO-8601 UTC text, with microseconds where there are any."""
    at = F.timestamp_micros(F.round(epoch * 1e6).cast("bigint"))
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(at, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction), F.lit("+00:00"))
