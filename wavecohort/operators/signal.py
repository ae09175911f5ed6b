"""Per-recording signal work, for all recordings at once.

A recording may be arbitrarily long, so nothing here windows over a whole recording.
Samples are first put in order and numbered (``sample_index``); after that every step
works on pieces of a fixed number of samples that overlap by as much as the step looks
sideways, or on aggregates. Keys are a list, so that several sensors go through one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wavecohort.functions.values import finite
from wavecohort.operators.ordered import (
    CHUNK,
    POS,
    Carry,
    chunk_window,
    halo,
    ordered_chunks,
    previous,
    rank_select,
    row_index,
    with_carry,
)
from wavecohort.session import durable

# Widths in seconds, caps and physiological limits.
MAX_POINTS = 2000
BASELINE_S = 1.5
NOISE_S = 0.05
MOTION_SMOOTH_S = 0.5
REFRACTORY_S = 0.35
PEAK_SIGMA = 0.3
BPM_LOW, BPM_HIGH = 30.0, 220.0
CHANNELS = ("ppg0", "ppg1", "ppg2")

#: Samples per piece. Pieces are at least four halos long, whatever the sample rate.
PIECE = 1 << 16
#: Samples a run of candidate peaks may span to be folded in one row; longer runs are
#: resolved by joins.
FOLD_SPAN = 4096


def sample_index(samples: DataFrame, keys: Sequence[str], columns: Sequence[str] = (), ts: str = "timestamp_ns") -> DataFrame:
    """Samples in time order with ``i`` (row number), ``n``, relative time ``t_s`` and ``fs``.

    ``fs`` is one over the median positive step between neighbours, 1.0 where there is none.
    The first and last values of ``columns`` come along as ``_first_*`` and ``_last_*``.
    Everything that concerns a whole recording is computed on one row per range and joined
    to the samples of that range. Samples that come with ``_chunk`` and ``_pos``, as stored ones do
    (``sources/samples.py``), are neither shuffled nor written again.
    """
    keys = list(keys)
    placed = samples if CHUNK in samples.columns else ordered_chunks(samples, keys, [ts], "samples")
    per_chunk = placed.groupBy(*keys, CHUNK).agg(
        F.count("*").alias("_c"),
        F.min(POS).alias("_p0"),
        F.min(ts).alias("_a"),
        F.max(ts).alias("_b"),
        *[F.min_by(c, POS).alias(f"_f_{c}") for c in columns],
        *[F.max_by(c, POS).alias(f"_l_{c}") for c in columns],
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    facts = durable(
        per_chunk.select(
            *keys,
            CHUNK,
            (F.coalesce(F.sum("_c").over(earlier), F.lit(0)) - F.col("_p0")).alias("_shift"),
            F.max("_b").over(earlier).alias("_earlier"),
            F.sum("_c").over(whole).alias("n"),
            F.min("_a").over(whole).alias("_t0"),
            *[F.min_by(f"_f_{c}", CHUNK).over(whole).alias(f"_first_{c}") for c in columns],
            *[F.max_by(f"_l_{c}", CHUNK).over(whole).alias(f"_last_{c}") for c in columns],
        ),
        "ranges",
    )
    before = F.lag(ts).over(Window.partitionBy(*keys, CHUNK).orderBy(POS))
    steps = (
        placed.select(*keys, ts, CHUNK, POS)
        .join(facts.select(*keys, CHUNK, "_earlier"), [*keys, CHUNK])
        .select(*keys, (F.col(ts) - F.coalesce(before, F.col("_earlier"))).alias("step"))
    )
    rated = facts.join(sample_rate(steps, keys), keys, "left").withColumn("fs", F.coalesce("fs", F.lit(1.0)))
    return (
        placed.join(rated.drop("_earlier"), [*keys, CHUNK])
        .withColumn("i", F.col(POS) + F.col("_shift"))
        .withColumn("t_s", (F.col(ts) - F.col("_t0")) / 1e9)
        .drop("_t0", "_shift", POS, CHUNK)
    )


def sample_rates(samples: DataFrame, keys: Sequence[str], ts: str = "timestamp_ns") -> DataFrame:
    """The rate ``fs`` of every recording, from its times alone; 1.0 where no step is positive."""
    if CHUNK in samples.columns:
        times = samples.select(*keys, ts, CHUNK, POS)
    else:
        times = ordered_chunks(samples.select(*keys, ts), keys, [ts], "times")
    steps = previous(times, keys, {"_before": F.col(ts)}).select(*keys, (F.col(ts) - F.col("_before")).alias("step"))
    rated = times.select(*keys).distinct().join(sample_rate(steps, keys), list(keys), "left")
    return rated.withColumn("fs", F.coalesce("fs", F.lit(1.0)))


def sample_rate(steps: DataFrame, keys: Sequence[str], step: str = "step") -> DataFrame:
    """Rate from the exact median of the positive steps; keys without such a step are left out."""
    middle = rank_select(
        steps.where(F.col(step) > 0),
        keys,
        step,
        {"_lo": F.expr("(n - 1) div 2"), "_hi": F.expr("n div 2")},
        4096,
    )
    return middle.select(*keys, F.try_divide(F.lit(1e9), (F.col("_lo") + F.col("_hi")) / 2.0).alias("fs"))


def odd_width(fs: Column, seconds: float, least: int) -> Column:
    """Samples in ``seconds``, made odd so that a window can be centred."""
    return F.greatest(F.lit(least).cast("bigint"), (fs * seconds).cast("bigint").bitwiseOR(F.lit(1)))


def optical_channels(samples: DataFrame) -> DataFrame:
    """Channels with the ambient light subtracted."""
    return samples.withColumns({c: F.col(c).cast("bigint") - F.col("ambient") for c in CHANNELS}).drop("ambient")


def channels_long(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per sample and channel."""
    return optical_channels(samples).unpivot(
        [*keys, "timestamp_ns"], list(CHANNELS), "channel", "value"
    )


def motion_magnitude(samples: DataFrame) -> DataFrame:
    square = lambda c: F.col(c).cast("double") * F.col(c).cast("double")
    return samples.withColumn("magnitude", F.sqrt(square("x") + square("y") + square("z"))).drop("x", "y", "z")


def _odd(c: Column) -> Column:
    """Null or not finite."""
    x = c.cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def moving_averages(indexed: DataFrame, keys: Sequence[str], columns: Sequence[str], widths: dict[str, Column]) -> DataFrame:
    """Centred moving averages with edge padding, one per column and width.

    The width may differ per key. A running sum read at ``i + h`` and at ``i - h - 1`` gives
    the sum of a window; scaling the row number by ``h + 1/2`` turns both into range frames
    with fixed bounds, so each costs one pass at any width. Beyond the ends the first and
    last value stand in for what is missing. Adds ``<column>_<width name>``: NaN where the
    window holds a value that is null or not finite, and only there.
    """
    keys = list(keys)
    half = {w: F.floor(e / 2).cast("bigint") for w, e in widths.items()}
    df = indexed.withColumns({f"_h_{w}": h for w, h in half.items()})
    reach = F.least(F.col("n"), F.greatest(F.lit(0), *[F.col(f"_h_{w}") for w in widths]))
    size = F.greatest(F.lit(PIECE).cast("bigint"), reach * 4)
    cut = halo(df, "i", size, before=reach + 1, after=reach + 1)
    for w in widths:
        cut = cut.withColumn(f"_k_{w}", F.col("i") / (F.col(f"_h_{w}") + 0.5))
    added = {}
    for w in widths:
        by = Window.partitionBy(*keys, "piece").orderBy(f"_k_{w}")
        upper = by.rangeBetween(Window.unboundedPreceding, 1)
        lower = by.rangeBetween(Window.unboundedPreceding, -1)
        h = F.col(f"_h_{w}")
        left = F.greatest(F.lit(0), h - F.col("i"))
        right = F.greatest(F.lit(0), F.col("i") + h - F.col("n") + 1)
        for c in columns:
            between = lambda x: F.coalesce(F.sum(x).over(upper), F.lit(0)) - F.coalesce(F.sum(x).over(lower), F.lit(0))
            good = F.when(~_odd(F.col(c)), F.col(c))
            edges = [(F.col(f"_first_{c}"), left), (F.col(f"_last_{c}"), right)]
            padded = between(good)
            odd = between(_odd(F.col(c)).cast("int")) > 0
            for value, times in edges:
                padded = padded + F.when((times > 0) & ~_odd(value), value * times).otherwise(0)
                odd = odd | ((times > 0) & _odd(value))
            mean = F.when(odd, F.lit(float("nan"))).otherwise(padded / (2 * h + 1))
            added[f"{c}_{w}"] = F.when(h == 0, F.col(c).cast("double")).otherwise(mean)
    return (
        cut.withColumns(added)
        .where("core")
        .drop("core", "piece", *[f"_{p}_{c}" for p in ("first", "last") for c in columns])
        .drop(*[f"_{p}_{w}" for p in ("h", "k") for w in widths])
    )


def pulse_band(indexed: DataFrame, keys: Sequence[str], columns: Sequence[str] = CHANNELS) -> DataFrame:
    """Short moving average minus wide one: keeps the pulse, drops drift and noise."""
    widths = {
        "base": odd_width(F.col("fs"), BASELINE_S, 3),
        "noise": odd_width(F.col("fs"), NOISE_S, 1),
    }
    averaged = moving_averages(indexed, keys, columns, widths)
    return averaged.select(*keys, "i", "n", "fs", "t_s", *[(F.col(f"{c}_noise") - F.col(f"{c}_base")).alias(c) for c in columns])


def best_channel(filtered: DataFrame, keys: Sequence[str], columns: Sequence[str] = CHANNELS) -> DataFrame:
    """Channel with the largest variance, the first one on ties, and that variance."""
    energies = filtered.groupBy(*keys).agg(
        *[F.var_pop(c).alias(c) for c in columns], F.max("n").alias("n"), F.max("fs").alias("fs")
    )
    choice = F.array_max(
        F.array(*[F.struct(F.col(c).alias("energy"), F.lit(-k).alias("k")) for k, c in enumerate(columns)])
    )
    return energies.select(*keys, "n", "fs", (-choice["k"]).alias("channel"), choice["energy"].alias("energy"))


def _per_piece(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-key facts as one row per piece, to be joined without a hot key."""
    size = F.lit(PIECE)
    return facts.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / size))))


def chosen_signal(filtered: DataFrame, keys: Sequence[str], columns: Sequence[str] = CHANNELS) -> DataFrame:
    """The best channel of each key as ``y``, with its number and its standard deviation."""
    facts = _per_piece(best_channel(filtered, keys, columns).drop("fs"), keys).drop("n")
    at = filtered.withColumn("_p", F.floor(F.col("i") / F.lit(PIECE)))
    picked = F.element_at(F.array(*columns), F.col("channel") + 1)
    return at.join(facts, [*keys, "_p"]).select(
        *keys, "i", "n", "t_s", "fs", picked.alias("y"), "channel", F.sqrt("energy").alias("sigma")
    )


def envelope(indexed: DataFrame, keys: Sequence[str], value: str, cap: int = MAX_POINTS, extra: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest value and middle time of at most ``cap`` buckets per key."""
    width = F.ceil(F.col("n") / F.lit(cap))
    bucket = F.floor(F.col("i") / width)
    length = F.least(width, F.col("n") - bucket * width)
    at = F.col("i") - bucket * width
    return indexed.select(
        *keys, *extra, bucket.alias("bucket"), value, "t_s", (at == F.floor(length / 2)).alias("_mid")
    ).groupBy(*keys, "bucket").agg(
        F.max(F.when(F.col("_mid"), F.col("t_s"))).alias("t_s"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        *[F.max(c).alias(c) for c in extra],
    )


def peak_candidates(signal: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples above both neighbours and above a share of the signal's spread."""
    cut = halo(signal, "i", F.lit(PIECE), before=F.lit(1), after=F.lit(1))
    w = Window.partitionBy(*keys, "piece").orderBy("i")
    y = F.col("y")
    return (
        cut.withColumns({"_l": F.lag("y").over(w), "_r": F.lead("y").over(w)})
        .where(F.col("core") & (y > F.col("_l")) & (y > F.col("_r")) & (y > F.col("sigma") * PEAK_SIGMA))
        .select(*keys, "i", "t_s", "y", "fs")
    )


def min_distance(fs: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), (fs * REFRACTORY_S).cast("bigint"))


def merge_peaks(candidates: DataFrame, keys: Sequence[str], fold_span: int = FOLD_SPAN) -> DataFrame:
    """Peaks at least a refractory distance apart, the taller of two close ones winning.

    The rule walks from left to right and holds one current peak. A candidate that is
    taller than all others within the distance before it becomes the current peak whatever
    came earlier, so the walk splits there into independent stretches. A stretch is folded
    in one row; a stretch of more than ``fold_span`` samples (only a steady decline or a
    plateau of copies makes one) is walked by doubling jumps between candidates instead.
    """
    keys = list(keys)
    df = candidates.withColumn("d", min_distance(F.col("fs")))
    cut = halo(df, "i", F.greatest(F.lit(PIECE).cast("bigint"), F.col("d") * 4), before=F.col("d"), after=F.lit(0))
    cut = cut.withColumn("_k", F.col("i") / (F.col("d") - 0.5))
    near = Window.partitionBy(*keys, "piece").orderBy("_k").rangeBetween(-1, 0)
    tallest = F.max(F.struct(F.col("y"), (-F.col("i")).alias("ni"))).over(near)
    start = F.when(tallest["ni"] == -F.col("i"), F.col("i"))
    marked = durable(cut.withColumn("_start", start).where("core").drop("_k", "core"), "candidates")
    # A stretch is named by its first candidate; the next stretch begins at a known peak,
    # which decides the fate of this one's last peak.
    line = with_carry(
        marked,
        keys,
        [Carry("_past", F.max("_start"), "max", "before"), Carry("_ahead", F.min("_start"), "min", "after")],
        "piece",
    )
    forward = chunk_window(keys, "piece", "i").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(*keys, "piece").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumns(
        {
            "stretch": F.coalesce(F.max("_start").over(forward), "_past"),
            "_next": F.coalesce(F.min("_start").over(backward), "_ahead"),
        }
    ).drop("_past", "_ahead", "_start")
    folded = durable(_folded(line, keys, fold_span), "stretches")
    long_ = F.col("_span") > fold_span
    longest = folded.where(long_).agg(F.max("_len")).first()[0]  # one number, to choose the plan
    peaks = folded.where(~long_).select(*keys, "fs", F.explode("peaks").alias("p"))
    peaks = peaks.select(*keys, "p.i", "p.t_s", "p.y", "fs")
    if longest is not None:
        rest = line.join(folded.where(long_).select(*keys, "stretch"), [*keys, "stretch"], "left_semi")
        peaks = peaks.unionByName(_jumped(rest, keys, longest))
    return peaks


def _folded(stretches: DataFrame, keys: list[str], fold_span: int) -> DataFrame:
    """Extent and surviving peaks of each stretch; no more than ``fold_span`` samples are gathered."""
    grouped = stretches.groupBy(*keys, "stretch").agg(
        F.array_sort(
            F.collect_list(F.when(F.col("i") - F.col("stretch") <= fold_span, F.struct("i", "y", "t_s")))
        ).alias("c"),
        F.count("*").alias("_len"),
        (F.max("i") - F.first("stretch")).alias("_span"),
        F.first("d").alias("d"),
        F.min("_next").alias("_next"),
        F.first("fs").alias("fs"),
    )
    first = F.col("c")[0]
    rest = F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0)))
    none = F.filter(F.slice("c", 1, 1), lambda x: F.lit(False))
    start = F.struct(first.alias("cur"), none.alias("done"))

    def step(state: Column, c: Column) -> Column:
        apart = c["i"] - state["cur"]["i"] >= F.col("d")
        taller = c["y"] > state["cur"]["y"]
        return F.struct(
            F.when(apart | taller, c).otherwise(state["cur"]).alias("cur"),
            F.when(apart, F.concat(state["done"], F.array(state["cur"]))).otherwise(state["done"]).alias("done"),
        )

    state = grouped.withColumn("s", F.aggregate(rest, start, step))
    stands = F.col("_next").isNull() | (F.col("_next") - F.col("s.cur.i") >= F.col("d"))
    done = F.when(stands, F.concat(F.col("s.done"), F.array(F.col("s.cur")))).otherwise(F.col("s.done"))
    return state.select(*keys, "stretch", "_len", "_span", "fs", done.alias("peaks"))


def _jumped(stretches: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Long stretches: each candidate knows which one follows it as current peak.

    Following those jumps from the stretch's first candidate visits exactly the walk's
    current peaks. Doubling the jumps reaches any length in a logarithm of rounds.
    """
    size = F.greatest(F.lit(PIECE).cast("bigint"), F.col("d") * 8)
    cut = halo(stretches.drop("piece"), "i", size, before=F.lit(0), after=2 * F.col("d"))
    cut = cut.withColumn("_k", F.col("i") / (F.col("d") + 0.0))
    ahead = Window.partitionBy(*keys, "stretch", "piece").orderBy("_k").rangeBetween(0, 2)
    later = F.filter(
        F.array_sort(F.collect_list(F.struct("i", "y")).over(ahead)),
        lambda c: (c["i"] > F.col("i")) & ((c["y"] > F.col("y")) | (c["i"] - F.col("i") >= F.col("d"))),
    )
    jumps = cut.withColumn("_to", F.get(later, F.lit(0))["i"]).where("core")
    jumps = durable(jumps.select(*keys, "stretch", "i", "y", "t_s", "fs", "d", "_next", "_to"), "jumps")
    seen = jumps.where(F.col("i") == F.col("stretch")).select(*keys, "i")
    table = jumps.where(F.col("_to").isNotNull()).select(*keys, F.col("i").alias("a"), F.col("_to").alias("b"))
    for _ in range(max(1, int(longest - 1).bit_length())):
        reached = seen.join(table, [*(seen[k] == table[k] for k in keys), seen["i"] == table["a"]]).select(
            *[seen[k] for k in keys], table["b"].alias("i")
        )
        seen = durable(seen.unionByName(reached).distinct(), "seen")
        further = table.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"))
        table = durable(table.join(further, [*keys, "b"]).select(*keys, "a", F.col("c").alias("b")), "table")
    following = F.coalesce("_to", "_next")
    stands = following.isNull() | (following - F.col("i") >= F.col("d"))
    return jumps.join(seen, [*keys, "i"], "left_semi").where(stands).select(*keys, "i", "t_s", "y", "fs")


def beat_intervals(peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every peak with the rate from the step to the peak before it; ``valid`` where plausible."""
    keys = list(keys)
    placed = peaks.withColumn("piece", F.floor(F.col("i") / F.lit(PIECE)))
    stepped = previous(placed, keys, {"_prev": F.col("t_s")}, "piece", "i")
    bpm = F.try_divide(F.lit(60.0), F.col("t_s") - F.col("_prev"))
    valid = F.coalesce((bpm > BPM_LOW) & (bpm < BPM_HIGH), F.lit(False))
    return stepped.select(*keys, "i", "t_s", bpm.alias("bpm"), valid.alias("valid"), "piece")


def beat_summary(beats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Peaks and mean plausible rate of each key with at least two peaks."""
    return (
        beats.groupBy(*keys)
        .agg(F.count("*").alias("n_beats"), F.avg(F.when(F.col("valid"), F.col("bpm"))).alias("mean_bpm"))
        .where(F.col("n_beats") >= 2)
        .withColumn("mean_bpm", finite(F.col("mean_bpm"), 1))
    )


def thin_evenly(beats: DataFrame, keys: Sequence[str], cap: int = MAX_POINTS) -> DataFrame:
    """At most ``cap`` beats of each key, evenly spaced and always with the first and the last.

    A beat is kept when some step of the even grid falls on it, which its own number decides.
    """
    numbered = row_index(beats, keys, "_r", "_m", "piece", "i")
    if cap < 2:
        return numbered.where(F.col("_r") < cap).drop("_r", "_m")
    step = F.ceil(F.col("_r") * F.lit(cap - 1) / F.greatest(F.col("_m") - 1, F.lit(1)))
    on_grid = F.floor(step * (F.col("_m") - 1) / F.lit(cap - 1)) == F.col("_r")
    return numbered.where((F.col("_m") <= cap) | on_grid).drop("_r", "_m")


def motion_envelope(motion: DataFrame, keys: Sequence[str], cap: int = MAX_POINTS) -> DataFrame:
    """Smoothed motion magnitude as an envelope; ``keys`` carry the sensor, so both take one pass."""
    indexed = sample_index(motion_magnitude(motion), keys, ["magnitude"])
    smooth = moving_averages(
        indexed, keys, ["magnitude"], {"smooth": odd_width(F.col("fs"), MOTION_SMOOTH_S, 1)}
    )
    return envelope(smooth, keys, "magnitude_smooth", cap, extra=["fs"])
