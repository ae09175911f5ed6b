"""Numbers as people read them. Text is rounded half to even unless it mirrors a browser."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\.?0+$", "")


def whole(column: Column) -> Column:
    return F.bround(column, 0).cast("bigint").cast("string")


def one_decimal(column: Column) -> Column:
    return F.bround(column, 1).cast("decimal(18,1)").cast("string")


def shortest(column: Column) -> Column:
    """Six significant digits without trailing zeros; scientific from a million on."""
    plain = lambda digits: _strip(
        F.concat(F.bround(column, digits).cast(f"decimal(18,{digits})").cast("string"), F.lit("" if digits else ".0"))
    )
    power = F.floor(F.log10(column))
    mantissa = F.bround(column / F.pow(F.lit(10.0), power), 5).cast("decimal(18,5)").cast("string")
    big = F.concat(_strip(mantissa), F.lit("e+"), F.lpad(power.cast("string"), 2, "0"))
    return (
        F.when(column < 1e4, plain(2))
        .when(column < 1e5, plain(1))
        .when(column < 999999.5, plain(0))
        .otherwise(big)
    )


def percent(share: Column) -> Column:
    return F.concat(whole(share * 100), F.lit("%"))


def days_or_hours(seconds: Column) -> Column:
    days = seconds / 86400.0
    return F.when(days < 1, F.concat(whole(seconds / 3600.0), F.lit(" h"))).otherwise(
        F.concat(whole(days), F.lit(" d"))
    )


def _nearest(column: Column) -> Column:
    return F.floor(column + 0.5).cast("bigint").cast("string")


def age_text(seconds: Column) -> Column:
    """'never', or the age in the largest unit that still tells something."""
    return (
        F.when(seconds.isNull(), "never")
        .when(seconds < 90, F.concat(_nearest(seconds), F.lit(" s ago")))
        .when(seconds / 60 < 90, F.concat(_nearest(seconds / 60), F.lit(" min ago")))
        .when(seconds / 3600 < 48, F.concat(_nearest(seconds / 3600), F.lit(" h ago")))
        .otherwise(F.concat(_nearest(seconds / 86400), F.lit(" d ago")))
    )


def unpaired_text(no_overlap: Column, never_read: Column, invalid: Column, suspect: Column, miss_s: Column) -> Column:
    """Which readings did not pair, and how far off the closest one was; empty when all did."""
    part = lambda n, words: F.when(n > 0, F.concat(n.cast("string"), F.lit(words)))
    # Wording shown to people.
    parts = F.concat_ws(
        ", ",
        part(no_overlap, " outside a recording"),
        part(never_read, " with no cuff clock"),
        part(invalid, " clock rejected"),
        part(suspect, " clock suspect"),
    )
    distance = F.when(miss_s < 5400, F.concat(_nearest(miss_s / 60), F.lit(" min"))).otherwise(
        F.concat(F.round(miss_s / 3600, 1).cast("decimal(18,1)").cast("string"), F.lit(" h"))
    )
    closest = F.when(miss_s.isNotNull(), F.concat(F.lit(" Closest miss "), distance, F.lit(".")))
    line = F.concat(F.lit("Unpaired: "), parts, F.lit("."), F.coalesce(closest, F.lit("")))
    return F.when(parts == "", "").otherwise(line)
