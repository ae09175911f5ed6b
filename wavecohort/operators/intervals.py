"""Matching points to intervals and to nearby measurements, by ordered sweeps.

No pair of rows is ever enumerated: intervals and points are merged into one time line per
subject, and each point reads what it needs from running values over that line.
"""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from wavecohort.operators.ordered import CHUNK, POS, Carry, chunk_window, ordered_chunks, running, with_carry
from wavecohort.session import durable

PAIR_WINDOW_S = 120.0
PAIR_HR_WINDOW_S = 90.0


def nearest_interval(
    points: DataFrame,
    intervals: DataFrame,
    on: str,
    point_time: str,
    start: str,
    end: str,
    interval_id: str,
    gap: str = "gap",
    match: str = "matched_id",
    by_id: bool = False,
) -> DataFrame:
    """Distance of every point to the closest interval of its subject, and that interval's id.

    Zero inside an interval, otherwise the distance to the nearer edge; null where the
    subject has none. Among equally close intervals the one ending last is named, then
    the one with the smallest id (a number); with ``by_id`` the one with the smallest id, but
    inside intervals, where ``smallest_containing`` tells it. Intervals without a start are dropped, an open end
    means length zero. Points with no time get no match.
    """
    cols = points.columns
    spans = intervals.where(F.col(start).isNotNull()).select(
        F.col(on),
        F.col(start).cast("double").alias("_t"),
        F.lit(0).alias("_kind"),
        F.greatest(F.coalesce(F.col(end), F.col(start)), F.col(start)).cast("double").alias("_end"),
        (-F.col(interval_id)).cast("bigint").alias("_nid"),
    )
    marks = points.where(F.col(point_time).isNotNull()).select(
        F.col(on),
        F.col(point_time).cast("double").alias("_t"),
        F.lit(1).alias("_kind"),
        F.struct(*cols).alias("_row"),
    )
    line = ordered_chunks(
        spans.unionByName(marks, allowMissingColumns=True), [on], ["_t", "_kind"], "sweep"
    )
    is_span = F.col("_kind") == 0
    ended = F.when(is_span, F.struct(F.col("_end"), F.col("_nid"), F.col("_t")))
    # Ordered so that the minimum is the earliest start, then the latest end, then the smallest id.
    later = F.lit(0.0) if by_id else -F.col("_end")
    ahead = F.when(is_span, F.struct(F.col("_t"), later.alias("_nend"), (-F.col("_nid")).alias("_id")))
    line = with_carry(
        line,
        [on],
        [Carry("_past", F.max(ended), "max", "before"), Carry("_next", F.min(ahead), "min", "after")],
    )
    forward = chunk_window([on]).rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(on, CHUNK).orderBy(F.desc(POS)).rowsBetween(Window.unboundedPreceding, 0)
    swept = line.select(
        on,
        "_t",
        "_row",
        "_kind",
        F.greatest(F.max(ended).over(forward), F.col("_past")).alias("_past"),
        F.least(F.min(ahead).over(backward), F.col("_next")).alias("_next"),
    ).where(F.col("_kind") == 1)
    behind_gap = F.when(
        F.col("_past").isNotNull(), F.greatest(F.lit(0.0), F.col("_t") - F.col("_past._end"))
    )
    ahead_gap = F.col("_next._t") - F.col("_t")
    take_ahead = F.col("_past").isNull() | (ahead_gap <= behind_gap)
    if by_id:
        take_ahead = F.col("_past").isNull() | (ahead_gap < behind_gap) | ((ahead_gap == behind_gap) & (F.col("_next._id") < -F.col("_past._nid")))
    found = swept.select(
        "_row.*",
        F.least(behind_gap, ahead_gap).alias(gap),
        F.when(F.col("_next").isNotNull() & take_ahead, F.col("_next._id"))
        .otherwise(-F.col("_past._nid"))
        .alias(match),
    )
    timeless = points.where(F.col(point_time).isNull()).select(
        *cols, F.lit(None).cast("double").alias(gap), F.lit(None).cast("bigint").alias(match)
    )
    return found.unionByName(timeless)


#: Dyadic nodes of the ranks from ``_lo`` to ``_hi``: at each level those at the ends that no larger node covers.
_COVER = """filter(flatten(transform(sequence(0, 47), k -> array(
    if(shiftright(_lo + shiftleft(1L, k) - 1, k) < shiftright(_hi + 1, k) and shiftright(_lo + shiftleft(1L, k) - 1, k) % 2 = 1,
       named_struct('level', k, 'node', shiftright(_lo + shiftleft(1L, k) - 1, k)), null),
    if(shiftright(_lo + shiftleft(1L, k) - 1, k) < shiftright(_hi + 1, k) and shiftright(_hi + 1, k) % 2 = 1,
       named_struct('level', k, 'node', shiftright(_hi + 1, k) - 1), null)))), x -> x is not null)"""


def smallest_containing(points: DataFrame, intervals: DataFrame, on: str, point_time: str, start: str, end: str, interval_id: str, match: str = "session_id") -> DataFrame:
    """Every point with the smallest id among all intervals of its subject that contain it, both ends included.

    A segment tree over the points' ranks: an interval is the ranks between its ends, cut into at most two nodes for each
    level of a binary tree; a node keeps the smallest id, combined before the shuffle; a point reads the nodes above
    its rank. Nested, crossing and many equal intervals cost no more than others. Intervals without a start are
    dropped, an open end, or one before the start, means length zero. Points without a time, or in no
    interval, have null. Up to 2**47 points of a subject.
    """
    spans = intervals.where(F.col(start).isNotNull()).select(
        F.col(on),
        F.col(start).cast("double").alias("_s"),
        F.greatest(F.coalesce(F.col(end), F.col(start)), F.col(start)).cast("double").alias("_e"),
        F.col(interval_id).cast("bigint").alias("_id"),
        F.monotonically_increasing_id().alias("_edge"),
    )
    side = lambda c, kind: F.struct(F.col(c).alias("_t"), F.lit(kind).alias("_kind"))
    edges = spans.select(on, "_id", "_edge", F.explode(F.array(side("_s", 0), side("_e", 2))).alias("_a")).select(on, "_id", "_edge", "_a.*")
    marks = points.where(F.col(point_time).isNotNull()).select(
        F.col(on), F.col(point_time).cast("double").alias("_t"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row")
    )
    line = ordered_chunks(edges.unionByName(marks, allowMissingColumns=True), [on], ["_t", "_kind"], "ranks")
    counted = running(line, [on], {"_i": F.when(F.col("_kind") == 1, 1).otherwise(0).cast("bigint")})
    counted = durable(counted.select(on, "_kind", "_edge", "_id", "_row", "_i"), "ranked")
    ranges = counted.where(F.col("_kind") != 1).groupBy(on, "_edge").agg(
        F.max(F.when(F.col("_kind") == 0, F.col("_i"))).alias("_lo"), F.max(F.when(F.col("_kind") == 2, F.col("_i") - 1)).alias("_hi"), F.max("_id").alias("_id")
    )
    cover = ranges.where(F.col("_lo") <= F.col("_hi")).select(on, "_id", F.explode(F.expr(_COVER)).alias("_n"))
    nodes = durable(cover.groupBy(on, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).agg(F.min("_id").alias("_id")), "nodes")
    levels = [r[0] for r in nodes.select("_level").distinct().collect()]  # at most 48 numbers
    ranked = counted.where(F.col("_kind") == 1).select(on, (F.col("_i") - 1).alias("_rank"), "_row")
    above = ranked.select(on, "_rank", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")).alias("_level"))
    above = above.withColumn("_node", F.expr("shiftright(_rank, _level)"))
    best = above.join(nodes, [on, "_level", "_node"]).groupBy(on, "_rank").agg(F.min("_id").alias(match))
    found = ranked.join(best, [on, "_rank"], "left").select("_row.*", match)
    timeless = points.where(F.col(point_time).isNull()).select("*", F.lit(None).cast("bigint").alias(match))
    return found.unionByName(timeless)


def containing_interval(
    points: DataFrame,
    intervals: DataFrame,
    on: str,
    point_time: str,
    start: str,
    end: str,
    interval_id: str,
    tolerance: float = PAIR_WINDOW_S,
    match: str = "session_id",
) -> DataFrame:
    """Points that fall inside an interval widened by ``tolerance``, each with one interval.

    It is the one of the smallest gap, zero inside; of several, the one with the smallest id.
    """
    near = nearest_interval(points, intervals, on, point_time, start, end, interval_id, "_gap", match, by_id=True)
    near = durable(near.where(F.col("_gap") <= tolerance), "near")
    inside = near.where(F.col("_gap") == 0).drop("_gap", match)
    within = smallest_containing(inside, intervals, on, point_time, start, end, interval_id, match)
    return within.unionByName(near.where(F.col("_gap") > 0).drop("_gap"))


def band_average(
    points: DataFrame,
    values: DataFrame,
    keys: Sequence[str],
    point_id: str,
    point_time: str,
    value_time: str,
    columns: Sequence[str],
    half_width: float = PAIR_HR_WINDOW_S,
    skip_nan: bool = False,
) -> DataFrame:
    """Mean of ``columns`` over the value rows within ``half_width`` seconds of each point.

    Every point asks twice for running totals, at both ends of its band; the mean is the
    difference. Totals are integers scaled by the largest value of the column, to 26 digits,
    so the difference is exact at any length and values of any size keep their precision. With no
    ``keys`` the values of all subjects count. A NaN value makes the mean NaN unless
    ``skip_nan``. Points without a value keep a null mean. One number for each column comes to the driver.
    """
    micros = lambda c: F.round(c * 1e6).cast("bigint")
    width = int(round(half_width * 1e6))
    odd = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    top = values.agg(*[F.max(F.when(~odd(F.col(c)), F.abs(F.col(c).cast("double")))).alias(c) for c in columns]).first()
    digits = {c: 26 - math.ceil(math.log10(top[c])) if top[c] else 0 for c in columns}
    # Two factors, since one power of ten alone may be out of a double's range.
    scaled = lambda c: F.col(c).cast("double") * F.lit(10.0 ** (digits[c] // 2)) * F.lit(10.0 ** (digits[c] - digits[c] // 2))
    measured = values.where(F.col(value_time).isNotNull()).select(
        *keys,
        micros(F.col(value_time)).alias("_t"),
        F.lit(1).alias("_kind"),
        *[F.when(~odd(F.col(c)), scaled(c).cast("decimal(28,0)")).alias(f"_x_{c}") for c in columns],
        *[F.when(odd(F.col(c)), 1).otherwise(0).alias(f"_odd_{c}") for c in columns],
    )
    asks = points.where(F.col(point_time).isNotNull()).select(
        *keys,
        F.col(point_id).alias("_pid"),
        F.explode(
            F.array(
                F.struct((micros(F.col(point_time)) - width).alias("_t"), F.lit(0).alias("_kind")),
                F.struct((micros(F.col(point_time)) + width).alias("_t"), F.lit(2).alias("_kind")),
            )
        ).alias("_ask"),
    ).select(*keys, "_pid", "_ask.*")
    line = measured.unionByName(asks, allowMissingColumns=True)
    keyed = list(keys)
    if not keyed:
        line = line.withColumn("_all", F.lit(0))
        keyed = ["_all"]
    line = ordered_chunks(line, keyed, ["_t", "_kind"], "band")
    zero = F.lit(0).cast("decimal(38,0)")
    totals = {}
    for c in columns:
        totals[f"_s_{c}"] = F.coalesce(F.col(f"_x_{c}"), zero)
        totals[f"_n_{c}"] = F.when(F.col(f"_x_{c}").isNotNull(), 1).otherwise(0)
        totals[f"_b_{c}"] = F.coalesce(F.col(f"_odd_{c}"), F.lit(0))
    asked = running(line, keyed, totals).where(F.col("_kind") != 1)
    sign = F.when(F.col("_kind") == 2, 1).otherwise(-1)
    diffs = asked.groupBy(F.col("_pid").alias(point_id)).agg(
        *[F.sum(F.col(t) * sign).alias(t) for t in totals]
    )
    means = []
    for c in columns:
        total = F.col(f"_s_{c}").cast("double") / F.lit(10.0 ** (digits[c] // 2)) / F.lit(10.0 ** (digits[c] - digits[c] // 2))
        mean = F.try_divide(total, F.col(f"_n_{c}"))
        if not skip_nan:
            mean = F.when(F.col(f"_b_{c}") > 0, F.lit(float("nan"))).otherwise(mean)
        means.append(mean.alias(c))
    return points.join(diffs.select(point_id, *means), point_id, "left")
