"""Collection status: everything a viewer is shown about arriving data."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from wavecohort.operators import collection as c, rules
from wavecohort.operators.scope import Scope, hide_unattributed, restrict, unrestricted, within_sessions
from wavecohort.session import durable


@dataclass
class CollectionStatus:
    """The blocks of the status within ``scope``; a block is planned when it is asked for."""

    tables: dict[str, DataFrame]
    now: float
    tz: str
    scope: Scope = None

    @cached_property
    def attributed(self) -> DataFrame:
        return c.attribute_sessions(self.tables["sessions"], self.tables["uploads"])

    @cached_property
    def sessions(self) -> DataFrame:
        return restrict(self.attributed, F.col("subject_id"), self.scope)

    @cached_property
    def readings(self) -> DataFrame:
        return restrict(self.tables["cuff_readings"], F.col("uploader_phone_id"), self.scope)

    @cached_property
    def placed(self) -> DataFrame:
        return c.place_readings(self.readings, self.tz)

    @cached_property
    def scoped_uploads(self) -> DataFrame:
        return restrict(self.tables["uploads"], F.col("uploader_phone_id"), self.scope)

    @cached_property
    def notes(self) -> DataFrame:
        return within_sessions(self.tables["notes"], self.attributed, self.scope)

    @cached_property
    def totals(self) -> DataFrame:
        return c.table_totals(self.tables, self.attributed, self.scope)

    @cached_property
    def outcomes(self) -> DataFrame:
        return c.reading_outcomes(c.reading_gaps(self.placed, self.sessions))

    @cached_property
    def subjects(self) -> DataFrame:
        """One row per subject; written once, since warnings and tiles read it too."""
        state = c.subject_state(
            c.recordings_by_subject(self.sessions),
            c.readings_by_subject(self.placed),
            c.pair_outcomes(self.outcomes),
            self.now,
        )
        return durable(state, "subjects")

    @cached_property
    def clock(self) -> DataFrame:
        return c.clock_provenance(self.readings)

    @cached_property
    def quality(self) -> DataFrame:
        return c.usable_minutes(hide_unattributed(self.tables["derived_ppg_minute"], self.scope))

    @cached_property
    def uploads(self) -> DataFrame:
        return c.uploads_by_status(self.scoped_uploads)

    @cached_property
    def uploads_pending(self) -> DataFrame:
        return c.upload_backlog(self.scoped_uploads, self.now)

    @cached_property
    def recent_sessions(self) -> DataFrame:
        if not unrestricted(self.scope):
            return c.recent_sessions(self.sessions, self.notes)
        latest = c.latest_sessions(self.tables["sessions"])
        return c.recent_sessions(c.attribute_sessions(latest, self.tables["uploads"]), self.notes)

    @cached_property
    def recent_cuff(self) -> DataFrame:
        return c.recent_readings(self.readings)

    @cached_property
    def markers(self) -> DataFrame:
        return c.recent_markers(self.notes)

    @cached_property
    def malformed_notes(self) -> DataFrame:
        return c.malformed_notes(self.notes)

    @cached_property
    def warnings(self) -> DataFrame:
        return rules.ranked(rules.all_warnings(self.subjects, self.clock, self.uploads_pending, self.quality))

    @cached_property
    def tiles(self) -> DataFrame:
        return rules.tile_states(self.subjects)
