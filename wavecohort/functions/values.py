"""Finite guards, rounding, identifiers and small predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNKNOWN = "unknown"


def finite(column: Column, digits: int | None = None) -> Column:
    """The value rounded half to even, or null where it is NaN or infinite."""
    value = column.cast("double")
    kept = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    return kept if digits is None else F.bround(kept, digits)


def subject_of(column: Column) -> Column:
    """Subject key of an uploader: missing and empty uploaders share one key."""
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(UNKNOWN))


def short_id(column: Column) -> Column:
    return F.substring(F.coalesce(column, F.lit("")), 1, 8)


def below(column: Column, limit: float) -> Column:
    return column < F.lit(limit)


def usable(sqi: Column, threshold: float = 0.8, inclusive: bool = False, nan_is_good: bool = False) -> Column:
    """Whether a quality value passes; NaN sorts above every number, so it is barred by default."""
    good = sqi >= F.lit(threshold) if inclusive else sqi > F.lit(threshold)
    return good if nan_is_good else good & ~F.isnan(sqi)


# Names a bundle may hold, and the size limit of one file.
FILE_NAME = r"^(manifest\.json|segments\.jsonl|notes\.jsonl|notes\.csv|[A-Za-z0-9][A-Za-z0-9._-]*\.rop)$"
MAX_FILE_BYTES = 200 * 1024 * 1024


def allowed_name(name: Column) -> Column:
    return name.rlike(FILE_NAME) & ~name.contains("/") & ~name.contains("..")


def allowed_size(n_bytes: Column, limit: int = MAX_FILE_BYTES) -> Column:
    return (n_bytes > 0) & (n_bytes <= F.lit(limit))


def reading_key(taken_at: Column, sys: Column, dia: Column, pulse: Column) -> Column:
    return F.concat_ws("|", taken_at, sys, dia, pulse)
