"""Signal operators against plain numpy on small recordings, with pieces small enough to cross."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecohort.operators import signal as s

KEY = ["session_id"]


def averaged(x, w):
    if w <= 1:
        return x.astype(float)
    half = w // 2
    padded = np.concatenate([np.full(half, x[0]), x, np.full(half, x[-1])]).astype(float)
    return np.array([padded[k : k + w].mean() for k in range(len(x))])


def walk(cands, d):
    """The refractory rule, one candidate at a time."""
    peaks = []
    for i, y in cands:
        if not peaks or i - peaks[-1][0] >= d:
            peaks.append((i, y))
        elif y > peaks[-1][1]:
            peaks[-1] = (i, y)
    return [i for i, _ in peaks]


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(s, "PIECE", 64)


def samples(spark, recordings):
    rows = [(sid, int(t), float(v)) for sid, (ts, xs) in recordings.items() for t, v in zip(ts, xs)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "session_id long, timestamp_ns long, x double")


def test_rate_ignores_gaps_repeats_and_short_recordings(spark):
    steady = np.arange(200) * 10_000_000
    steady[100:] += 5_000_000_000
    df = samples(spark, {1: (steady, np.zeros(200)), 2: ([5], [1.0]), 3: ([7, 7, 7], [1, 2, 3])})
    rates = {r.session_id: r.fs for r in s.sample_index(df, KEY).select("session_id", "fs").distinct().collect()}
    assert rates[1] == pytest.approx(100.0)
    assert rates[2] == 1.0 and rates[3] == 1.0


def test_even_count_median_step(spark):
    df = samples(spark, {1: ([0, 10, 30], [0, 0, 0])})
    assert s.sample_index(df, KEY).first().fs == pytest.approx(1e9 / 15)


@pytest.mark.parametrize("fs", [25, 176])
def test_moving_average_equals_numpy_across_pieces(spark, small_pieces, fs):
    rng = np.random.default_rng(5)
    recs = {k: (np.arange(n) * int(1e9 / fs), rng.normal(size=n)) for k, n in ((1, 700), (2, 3), (3, 1), (4, 129))}
    indexed = s.sample_index(samples(spark, recs), KEY, ["x"])
    widths = {"base": s.odd_width(F.col("fs"), 1.5, 3), "noise": s.odd_width(F.col("fs"), 0.05, 1)}
    got = s.moving_averages(indexed, KEY, ["x"], widths).orderBy("i").collect()
    for sid, (ts, xs) in recs.items():
        mine = [r for r in got if r.session_id == sid]
        assert [r.i for r in mine] == list(range(len(xs)))
        rate = mine[0].fs
        for name, seconds, least in (("base", 1.5, 3), ("noise", 0.05, 1)):
            want = averaged(np.asarray(xs), max(least, int(rate * seconds) | 1))
            assert np.allclose([r[f"x_{name}"] for r in mine], want, atol=1e-9)


def test_envelope_keeps_a_spike_and_is_bounded(spark):
    n = 10_000
    xs = np.zeros(n)
    xs[4321] = 100
    indexed = s.sample_index(samples(spark, {1: (np.arange(n) * 1000, xs)}), KEY)
    rows = s.envelope(indexed, KEY, "x", 100).collect()
    assert len(rows) == 100 and max(r.hi for r in rows) == 100 and min(r.lo for r in rows) == 0


@pytest.mark.parametrize("n", [10, 100, 101, 1234])
def test_envelope_equals_buckets(spark, n):
    xs = np.random.default_rng(n).normal(size=n)
    ts = np.arange(n) * 1_000_000
    got = s.envelope(s.sample_index(samples(spark, {1: (ts, xs)}), KEY), KEY, "x", 100).orderBy("bucket").collect()
    width = math.ceil(n / 100)
    want = [xs[k : k + width] for k in range(0, n, width)]
    assert [r.lo for r in got] == pytest.approx([w.min() for w in want])
    assert [r.hi for r in got] == pytest.approx([w.max() for w in want])
    mids = [(k * width + len(w) // 2) * 1e-3 for k, w in enumerate(want)]
    assert [r.t_s for r in got] == pytest.approx(mids)


def candidates(spark, series, fs):
    rows = [(sid, i, i / fs, float(y), float(fs)) for sid, cs in series.items() for i, y in cs]
    return spark.createDataFrame(rows, "session_id long, i long, t_s double, y double, fs double")


@pytest.mark.parametrize("fold_span", [0, 40, 4096])
def test_refractory_walk_equals_loop(spark, small_pieces, fold_span):
    rng = random.Random(fold_span)
    series = {}
    for sid in range(30):
        at, cs = 0, []
        for _ in range(rng.randint(1, 120)):
            at += rng.choice([2, 3, 5, 9, 20])
            cs.append((at, rng.choice([1, 2, 3, 4]) if sid % 2 else rng.random()))
        series[sid] = cs
    # What makes long stretches: a plateau of equal heights and a steady decline.
    series[100] = [(4 * k, 7.0) for k in range(400)]
    series[101] = [(5 * k, 500.0 - k) for k in range(300)]
    fs = 40  # refractory distance 14
    got = s.merge_peaks(candidates(spark, series, fs), KEY, fold_span).collect()
    for sid, cs in series.items():
        assert sorted(r.i for r in got if r.session_id == sid) == walk(cs, 14), sid


def test_sine_has_its_beats_and_rate(spark, small_pieces):
    fs, seconds = 176, 20
    t = np.arange(fs * seconds)
    xs = np.sin(2 * np.pi * (70 / 60) * t / fs)
    indexed = s.sample_index(samples(spark, {1: (t * int(1e9 / fs), xs), 2: (t * 1000, np.ones(len(t)))}), KEY)
    sig = indexed.select("session_id", "i", "n", "t_s", "fs", F.col("x").alias("y")).withColumn(
        "sigma", F.lit(float(np.std(xs)))
    )
    beats = s.beat_intervals(s.merge_peaks(s.peak_candidates(sig, KEY), KEY), KEY)
    rows = s.beat_summary(beats, KEY).collect()
    assert [r.session_id for r in rows] == [1]  # a flat recording has no peaks
    assert abs(rows[0].n_beats - 23) <= 3 and rows[0].mean_bpm == pytest.approx(70, abs=1)


@pytest.mark.parametrize("m", [1, 2, 99, 100, 101, 250, 1001])
def test_thinning_equals_linspace(spark, m):
    beats = spark.range(m).select(F.lit(1).alias("session_id"), F.col("id").alias("i"), F.floor(F.col("id") / 64).alias("piece"))
    got = sorted(r.i for r in s.thin_evenly(beats, KEY, 100).collect())
    want = list(range(m)) if m <= 100 else sorted(set(np.linspace(0, m - 1, 100).astype(int).tolist()))
    assert got == want


def test_best_channel_takes_the_first_of_equals(spark):
    rows = [(1, k, 10, 1.0, float(k % 3), float(k % 3), 0.0) for k in range(10)]
    df = spark.createDataFrame(rows, "session_id long, i long, n long, fs double, ppg0 double, ppg1 double, ppg2 double")
    assert s.best_channel(df, KEY).first().channel == 0


def test_repeated_timestamps_keep_every_sample(spark):
    df = samples(spark, {1: ([5] * 50 + [6] * 50, np.arange(100))})
    rows = s.sample_index(df, KEY).collect()
    assert sorted(r.i for r in rows) == list(range(100)) and {r.n for r in rows} == {100}


def test_a_moving_average_blanks_only_windows_with_a_bad_value(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from wavecohort.operators.signal import moving_averages

    draw = np.random.default_rng(2)
    x = draw.standard_normal(300) * 1e3
    x[[0, 50, 120, 299]] = [np.nan, np.inf, np.nan, 5.0]
    values = [None if i == 200 else float(v) for i, v in enumerate(x)]
    rows = [("k", i, 300, v, values[0], values[-1]) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "key string, i long, n long, v double, _first_v double, _last_v double")
    got = moving_averages(table, ["key"], ["v"], {"w": F.lit(13)}).orderBy("i").collect()
    padded = np.concatenate(([np.nan] * 6, [np.nan if v is None else v for v in values], [5.0] * 6))
    wanted = np.array([padded[i : i + 13].mean() for i in range(300)])
    wanted[~np.isfinite(wanted)] = np.nan
    assert np.allclose([r.v_w for r in got], wanted, equal_nan=True)


def test_band_means_keep_small_and_large_values(spark):
    from wavecohort.operators.intervals import band_average

    points = spark.createDataFrame([("a", 100.0), ("b", 1000.0)], "id string, t double")
    for scale in (1e-9, 1.0, 1.5e13, 1e200):
        values = spark.createDataFrame([(99.0, 1.0 * scale), (101.0, 2.0 * scale), (1000.0, 0.25 * scale)], "ts double, x double")
        got = {r.id: r.x for r in band_average(points, values, [], "id", "t", "ts", ["x"]).collect()}
        assert abs(got["a"] / scale - 1.5) < 1e-12 and abs(got["b"] / scale - 0.25) < 1e-12
