"""Series: everything drawn over time, per subject."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from wavecohort.operators import trends
from wavecohort.operators.collection import attribute_sessions, place_readings
from wavecohort.operators.scope import Scope, hide_unattributed, restrict
from wavecohort.session import durable


@dataclass
class Series:
    """The series of the last ``days`` (0 or None: of all time) within ``scope``; each is planned when it is asked for."""

    tables: dict[str, DataFrame]
    now: float
    tz: str
    days: int | None = None
    scope: Scope = None

    @cached_property
    def attributed(self) -> DataFrame:
        owned = attribute_sessions(self.tables["sessions"], self.tables["uploads"])
        return restrict(owned, F.col("subject_id"), self.scope)

    @cached_property
    def placed(self) -> DataFrame:
        readings = restrict(self.tables["cuff_readings"], F.col("uploader_phone_id"), self.scope)
        return place_readings(readings, self.tz)

    @cached_property
    def minutes(self) -> DataFrame:
        return hide_unattributed(self.tables["derived_ppg_minute"], self.scope)

    @cached_property
    def cuff(self) -> DataFrame:
        """All points; ``drawn`` has the newest of each subject."""
        return trends.reading_points(self.placed, self.now, self.days)

    @cached_property
    def drawn(self) -> DataFrame:
        return trends.newest_points(self.cuff).orderBy("ts")

    @cached_property
    def daily(self) -> DataFrame:
        return trends.daily_summary(self.cuff, self.tz)

    @cached_property
    def hour_profile(self) -> DataFrame:
        return trends.hour_profile(self.cuff, self.tz)

    @cached_property
    def coverage(self) -> DataFrame:
        return trends.coverage_days(
            trends.recorded_by_day(self.attributed, self.tz, self.now, self.days),
            trends.readings_by_day(self.placed, self.now, self.days),
        ).orderBy("day", "subject_id")

    def calendar(self, first_day: str, last_day: str) -> DataFrame:
        """Coverage with the days that have none."""
        return trends.calendar(self.coverage, first_day, last_day)

    @cached_property
    def coverage_totals(self) -> DataFrame:
        return trends.coverage_totals(self.coverage)

    @cached_property
    def quality(self) -> DataFrame:
        return trends.hourly_quality(self.minutes, self.now, self.days).orderBy("bucket")

    @cached_property
    def quality_flags(self) -> DataFrame:
        return trends.quality_flags(self.quality)

    @cached_property
    def pairs(self) -> DataFrame:
        """Written once: the pairs, their agreement and its limits all read it."""
        return durable(trends.pair_points(self.placed, self.attributed, self.minutes), "pairs")

    @cached_property
    def agreement(self) -> DataFrame:
        return trends.agreement(self.pairs)

    @cached_property
    def agreement_limits(self) -> DataFrame:
        return trends.agreement_limits(self.pairs)

    @cached_property
    def trend(self) -> DataFrame:
        return trends.adaptive_points(self.cuff, self.tz)

    @cached_property
    def hours(self) -> DataFrame:
        return trends.hour_of_day(self.cuff, self.tz)

    @cached_property
    def reading_runs(self) -> DataFrame:
        return trends.run_summary(self.cuff, ["subject_id"], "ts", trends.READING_GAP_S)

    @cached_property
    def quality_runs(self) -> DataFrame:
        """Runs of hours that have a quality value."""
        hours = self.quality.where(F.col("sqi").isNotNull()).withColumn("store", F.lit("all"))
        return trends.run_summary(hours, ["store"], "bucket", trends.QUALITY_GAP_S)
