"""Who may see which subject, applied as filters and semi joins before anything is read out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from wavecohort.functions.values import subject_of

ALL_SUBJECTS = "*"

Scope = Sequence[str] | DataFrame | None


def unrestricted(scope: Scope) -> bool:
    """Whether a scope shows everything; of one held as a DataFrame a single row is looked for."""
    if isinstance(scope, DataFrame):
        return not scope.where(F.col(scope.columns[0]) == ALL_SUBJECTS).isEmpty()
    return scope is None or ALL_SUBJECTS in scope


def scope_of(grants: DataFrame, viewer: str, name: str, subject: str = "subject_id") -> DataFrame:
    """The scope of one viewer from resolved grants: its subjects, ``*`` for all, no row for none."""
    return grants.where(F.col(viewer) == name).select(subject)


def restrict(df: DataFrame, subject: Column, scope: Scope) -> DataFrame:
    """Rows of the subjects in scope: no scope or ``*`` keeps all, an empty scope keeps none.

    A scope held as a one-column DataFrame, such as a viewer's resolved grants, means the same and is
    applied as a semi join.
    """
    if unrestricted(scope):
        return df
    if isinstance(scope, DataFrame):
        held = scope.select(F.col(scope.columns[0]).alias("_subject"))
        return df.join(held, subject_of(subject) == F.col("_subject"), "left_semi")
    if not scope:
        return df.where(F.lit(False))
    return df.where(subject_of(subject).isin(*scope))


def resolve_grants(grants: DataFrame, viewer: str, subjects: str) -> DataFrame:
    """One row per viewer and granted subject.

    A missing list grants everything, a plain string grants that one subject, blank
    entries are dropped; a viewer left with no row is denied.
    """
    listed = F.col(subjects)
    if isinstance(grants.schema[subjects].dataType, StringType):
        listed = F.when(listed.isNotNull(), F.array(listed))
    everything = F.array(F.lit(ALL_SUBJECTS))
    return (
        grants.select(viewer, F.explode(F.coalesce(listed, everything)).alias("subject_id"))
        .where(F.trim("subject_id") != "")
        .distinct()
    )


def granted_counts(df: DataFrame, subject: Column, grants: DataFrame, viewer: str) -> DataFrame:
    """Rows each viewer may see; the wildcard reads the total, so no viewer meets every subject."""
    per_subject = df.groupBy(subject_of(subject).alias("subject_id")).agg(F.count("*").alias("n"))
    total = per_subject.agg(F.sum("n").alias("n")).select(F.lit(ALL_SUBJECTS).alias("subject_id"), "n")
    facts = per_subject.unionByName(total)
    seen = grants.join(facts, "subject_id", "left")
    wild = F.max(F.when(F.col("subject_id") == ALL_SUBJECTS, F.coalesce("n", F.lit(0))))
    named = F.sum(F.coalesce("n", F.lit(0)))
    return seen.groupBy(viewer).agg(
        F.max(F.col("subject_id") == ALL_SUBJECTS).alias("sees_all"),
        F.coalesce(wild, named).alias("visible_rows"),
    )


def scoped_session_ids(attributed: DataFrame, scope: Scope) -> DataFrame:
    """Ids of the recordings in scope, for semi joins on child tables."""
    return restrict(attributed, F.col("subject_id"), scope).select(F.col("id").alias("session_id"))


def within_sessions(child: DataFrame, attributed: DataFrame, scope: Scope) -> DataFrame:
    """Child rows (samples, notes) of recordings in scope."""
    if unrestricted(scope):
        return child
    return child.join(scoped_session_ids(attributed, scope), "session_id", "left_semi")


def hide_unattributed(df: DataFrame, scope: Scope, subject: str = "subject_id") -> DataFrame:
    """A table without a subject column shows nothing to a restricted viewer."""
    if unrestricted(scope):
        return df
    if subject in df.columns:
        return restrict(df, F.col(subject), scope)
    return df.where(F.lit(False))
