"""Tables in folders of day and subject part, of which a look-back within a scope opens only what it needs.

The day bounds the folders while planning. A scope held as a table, such as a viewer's grants, prunes
them while running: its subjects' parts are sent to the scan before it lists files (dynamic partition pruning).
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from wavecohort.functions.values import subject_of
from wavecohort.operators.scope import Scope, unrestricted

DAY, PART = "_day", "_part"
PARTS = 64


def part_of(subject: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(subject), F.lit(parts)).cast("int")


def day_of(epoch: Column) -> Column:
    """The UTC day of an epoch as text."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")


def first_day(now: float, days: int | None) -> str | None:
    """A day that is not after the first of a look-back in any zone; no look-back has none."""
    if not days:
        return None
    return (datetime.datetime.fromtimestamp(now - days * 86400, datetime.timezone.utc) - datetime.timedelta(days=1)).strftime("%Y-%m-%d")


def write_days(rows: DataFrame, path: str, day: Column, subject: Column, parts: int = PARTS, mode: str = "append") -> None:
    """Write rows by day (text) and part of their subject; a subject's or a day's many rows spread over files.

    A table keeps its number of parts for life. Rows without a day lie in a folder of their own.
    """
    placed = rows.withColumns({DAY: day, PART: part_of(subject_of(subject), parts)})
    placed.hint("rebalance", DAY, PART).write.mode(mode).partitionBy(DAY, PART).parquet(path)


def read_days(spark: SparkSession, path: str, schema: StructType, subject: str, since: str | None = None, scope: Scope = None, parts: int = PARTS) -> DataFrame:
    """Rows of days from ``since`` on (none: all, rows without a day too) of the subjects in ``scope``.

    Days bound whole folders, so a look-back by time is still to be applied. No scope or ``*`` keeps
    all subjects, an empty one none.
    """
    full = StructType([*schema.fields]).add(DAY, "string").add(PART, "integer")
    rows = spark.read.schema(full).parquet(path)
    if since is not None:
        rows = rows.where(F.col(DAY) >= since)
    if not unrestricted(scope):
        who = subject_of(F.col(subject))
        if isinstance(scope, DataFrame):
            held = scope.select(F.col(scope.columns[0]).alias("_subject")).withColumn("_p", part_of(F.col("_subject"), parts))
            rows = rows.join(held, (F.col(PART) == F.col("_p")) & (who == F.col("_subject")), "left_semi")
        elif not scope:
            rows = rows.where(F.lit(False))
        else:
            rows = rows.where(F.col(PART).isin(*[part_of(F.lit(s), parts) for s in scope]) & who.isin(*scope))
    return rows.drop(DAY, PART)
