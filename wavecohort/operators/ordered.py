"""Ordered work on groups of any size.

A window over one key puts that key's rows into one task. A key here may hold a third of
the data, so ordered operators work on *chunks*: rows are range-partitioned on
(keys, order), each range is sorted by one task, and what must cross a chunk border
(counts, running maxima, last values) is carried through one small summary row per
(key, chunk). A key spanning the whole data still spreads over all ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wavecohort.session import durable

CHUNK = "_chunk"
POS = "_pos"


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` in total order of (keys, order): adds the range ``_chunk`` and position ``_pos``.

    Rows equal in the order columns are told apart by a hash of the whole row, exact
    copies by a random draw, so that no run of equal rows is tied to one range. Only exact
    copies, which are interchangeable, can move between ranges if a task is run again.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in (*keys, *order)]
    ties = [F.xxhash64(*[F.col(c) for c in df.columns]), F.rand(11)]
    names = [f"_o{n}" for n in range(len(cols) + len(ties))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip((*cols, *ties), names)])
    at = F.monotonically_increasing_id()  # range number in the upper bits, row number below
    placed = (
        keyed.repartitionByRange(*names)
        .sortWithinPartitions(*names)
        .select(*df.columns, at.alias("_at"))
        .select(
            *df.columns,
            F.shiftright("_at", 33).alias(CHUNK),
            F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias(POS),
        )
    )
    return durable(placed, name)


@dataclass(frozen=True)
class Carry:
    """One value carried between the chunks of a key.

    ``within`` aggregates the rows of a chunk; ``across`` combines the chunk values
    ('sum', 'max', 'min' or 'last') of all chunks ``before``, ``after`` or in ``all``.
    """

    name: str
    within: Column
    across: str
    side: str = "before"


def carried(df: DataFrame, keys: Sequence[str], carries: Sequence[Carry], chunk: str = CHUNK) -> DataFrame:
    """One row per (keys, chunk) with the carried values: as many rows as chunks, not as input rows."""
    per_chunk = df.groupBy(*keys, chunk).agg(*[c.within.alias(f"_w_{c.name}") for c in carries])
    by_key = Window.partitionBy(*keys)
    frames = {
        "before": by_key.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1),
        "after": by_key.orderBy(F.desc(chunk)).rowsBetween(Window.unboundedPreceding, -1),
        "all": by_key,
    }
    combine = {
        "sum": F.sum,
        "max": F.max,
        "min": F.min,
        "last": lambda c: F.last(c, ignorenulls=True),
    }
    return per_chunk.select(
        *keys,
        chunk,
        *[combine[c.across](F.col(f"_w_{c.name}")).over(frames[c.side]).alias(c.name) for c in carries],
    )


def with_carry(df: DataFrame, keys: Sequence[str], carries: Sequence[Carry], chunk: str = CHUNK) -> DataFrame:
    """Attach the carried values to every row; joins on (keys, chunk), so no key is hot."""
    return df.join(carried(df, keys, carries, chunk), [*keys, chunk], "left")


def chunk_window(keys: Sequence[str], chunk: str = CHUNK, pos: str = POS):
    return Window.partitionBy(*keys, chunk).orderBy(pos)


def running(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], chunk: str = CHUNK, pos: str = POS) -> DataFrame:
    """Inclusive running sums over each whole key, added under the given names."""
    df = df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()])
    df = with_carry(df, keys, [Carry(f"_c_{n}", F.sum(f"_v_{n}"), "sum") for n in sums], chunk)
    upto = chunk_window(keys, chunk, pos).rowsBetween(Window.unboundedPreceding, 0)
    added = {
        n: F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) for n in sums
    }
    return df.withColumns(added).drop(*[f"_v_{n}" for n in sums], *[f"_c_{n}" for n in sums])


def previous(df: DataFrame, keys: Sequence[str], values: dict[str, Column], chunk: str = CHUNK, pos: str = POS) -> DataFrame:
    """The preceding row's value within the key, across chunk borders; values must not be null."""
    df = with_carry(
        df, keys, [Carry(f"_c_{n}", F.max_by(c, F.col(pos)), "last") for n, c in values.items()], chunk
    )
    w = chunk_window(keys, chunk, pos)
    added = {n: F.coalesce(F.lag(c).over(w), F.col(f"_c_{n}")) for n, c in values.items()}
    return df.withColumns(added).drop(*[f"_c_{n}" for n in values])


def row_index(df: DataFrame, keys: Sequence[str], index: str = "i", total: str = "n", chunk: str = CHUNK, pos: str = POS) -> DataFrame:
    """Zero-based row number within the key and the key's row count."""
    df = with_carry(
        df,
        keys,
        [
            Carry("_before", F.count("*"), "sum"),
            Carry(total, F.count("*"), "sum", "all"),
        ],
        chunk,
    )
    at = F.coalesce("_before", F.lit(0)) + F.row_number().over(chunk_window(keys, chunk, pos)) - 1
    return df.withColumn(index, at).drop("_before")


def halo(df: DataFrame, index: str, size: Column, before: Column, after: Column, piece: str = "piece", core: str = "core") -> DataFrame:
    """Cut an indexed key into pieces of ``size`` rows that overlap by a halo.

    A row goes to its own piece (``core`` true) and to every piece whose range, widened by
    ``before`` rows on the left and ``after`` rows on the right, contains it.
    """
    own = F.floor(F.col(index) / size)
    first = F.greatest(F.lit(0), F.floor((F.col(index) - after) / size))
    last = F.floor((F.col(index) + before) / size)
    cut = df.select("*", own.alias("_own"), F.explode(F.sequence(first, last)).alias(piece))
    return cut.withColumn(core, F.col(piece) == F.col("_own")).drop("_own")


#: Binary digits by which a rank is narrowed down in one step, and so at most 2**13 counts of a key in one window.
FAN_BITS = 13


def rank_select(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], width: float, fan_bits: int = FAN_BITS) -> DataFrame:
    """Exact order statistics per key: the value at each zero-based rank.

    ``ranks`` are expressions over the row count ``n``. Rows are first combined to counts per distinct value and
    those to counts per band of ``width``. Bands are numbers of some digits: the wanted ranks are located among the first
    digits of a key, then among the second digits below those that hold one, and so on to the band and,
    inside it, the value. No window sees more than ``2**fan_bits`` counts, or the distinct values of one
    band, however many a key has. The driver sees the largest band number.
    """
    counts = durable(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.floor(F.col(value) / F.lit(width)).alias("_band"), F.col(value).alias("_v"))
        .agg(F.count("*").alias("_c")),
        "counts",
    )
    top = counts.agg(F.max(F.greatest(F.col("_band"), -F.col("_band") - 1))).first()[0] or 0
    above = -(-max(0, int(top).bit_length() + 1 - fan_bits) // fan_bits)
    tables = [counts.groupBy(*keys, "_band").agg(F.sum("_c").alias("_c")).withColumnRenamed("_band", "_d")]
    for _ in range(above):
        up = F.shiftright("_d", fan_bits).alias("_d")
        tables.append(tables[-1].groupBy(*keys, up).agg(F.sum("_c").alias("_c")))
    by_key = Window.partitionBy(*keys)
    named = F.array(*[F.struct(F.lit(r).alias("name"), e.cast("bigint").alias("rank")) for r, e in ranks.items()])
    here = lambda r: (r["rank"] >= F.col("_lo")) & (r["rank"] < F.col("_lo") + F.col("_c"))
    wanted = tables[-1].select(
        *keys, "_d", (F.sum("_c").over(by_key.orderBy("_d")) - F.col("_c")).alias("_lo"), "_c", F.sum("_c").over(by_key).alias("n")
    ).select(*keys, "_d", "_lo", F.filter(named, here).alias("_want"))
    for table in tables[-2::-1]:
        parents = wanted.where(F.size("_want") > 0).withColumnsRenamed({"_d": "_p", "_lo": "_from"})
        children = table.withColumn("_p", F.shiftright("_d", fan_bits)).join(parents, [*keys, "_p"])
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy("_d"))
        placed = children.withColumn("_lo", F.col("_from") + upto - F.col("_c"))
        wanted = placed.select(*keys, "_d", "_lo", F.filter("_want", here).alias("_want"))
    wanted = wanted.where(F.size("_want") > 0).withColumnRenamed("_d", "_band")
    inside = counts.join(wanted, [*keys, "_band"])
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_band").orderBy("_v")) + F.col("_lo")
    reached = inside.withColumn("_upto", upto)
    hit = lambda r: (r["rank"] < F.col("_upto")) & (r["rank"] >= F.col("_upto") - F.col("_c"))
    picked = reached.select(*keys, "_v", F.explode(F.filter("_want", hit)).alias("_w"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_w.name") == r, F.col("_v"))).alias(r) for r in ranks]
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salts: int = 256) -> DataFrame:
    """The first ``k`` rows of every key.

    Rows are cut three times: to ``k`` per key inside each scan task, before any shuffle,
    then to ``k`` per key and salt, then to ``k`` per key. The salt is the task's number, so
    the first cut sees all of a key's rows of that task.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    partial = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    cut = salted.withColumn("_rn", F.row_number().over(partial)).where(F.col("_rn") <= k)
    return cut.withColumn("_rn", F.row_number().over(final)).where(F.col("_rn") <= k).drop("_salt", "_rn")


def gap_runs(df: DataFrame, keys: Sequence[str], ts: str, gap: float, run: str = "run") -> DataFrame:
    """Number the runs of each key: a new run starts where the step exceeds ``gap``."""
    placed = ordered_chunks(df, keys, [ts], "runs")
    stepped = previous(placed, keys, {"_prev": F.col(ts)})
    starts = F.when(F.col(ts) - F.col("_prev") > F.lit(gap), 1).otherwise(0).cast("bigint")
    return running(stepped, keys, {run: starts}).drop("_prev", CHUNK, POS)
