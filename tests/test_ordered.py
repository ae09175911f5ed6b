"""Ordered operators against brute force, with a key that holds most rows and many copies."""

import random

import pytest
from pyspark.sql import functions as F

from wavecohort.operators import intervals as iv
from wavecohort.operators import ordered as o


@pytest.fixture(autouse=True)
def no_coalescing(spark):
    """Keep the small test data in several ranges, so that carries are exercised."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def subjects(n, rng):
    return ["hot" if rng.random() < 0.6 else rng.choice("abc") for _ in range(n)]


def test_a_hot_key_spreads_over_ranges(spark):
    rng = random.Random(1)
    rows = [(k, float(rng.choice([1.0, 1.0, 2.0]))) for k in subjects(3000, rng)]
    df = spark.createDataFrame(rows, "k string, t double")
    placed = o.ordered_chunks(df, ["k"], ["t"], "t")
    sizes = [r["count"] for r in placed.groupBy("_chunk").count().collect()]
    assert placed.count() == 3000 and len(sizes) > 4 and max(sizes) < 1500


def test_running_previous_and_index(spark):
    rng = random.Random(2)
    rows = [(k, n, rng.randint(0, 10_000)) for n, k in enumerate(subjects(1500, rng))]
    df = spark.createDataFrame(rows, "k string, id long, t long")
    placed = o.ordered_chunks(df, ["k"], ["t", "id"], "t")
    out = o.row_index(o.running(o.previous(placed, ["k"], {"prev": F.col("id")}), ["k"], {"s": F.col("t")}), ["k"])
    got = {r.id: (r.prev, r.s, r.i, r.n) for r in out.collect()}
    for key in {k for k, _, _ in rows}:
        mine = sorted((t, n) for k, n, t in rows if k == key)
        total, prev = 0, None
        for place, (t, n) in enumerate(mine):
            total += t
            assert got[n] == (prev, total, place, len(mine))
            prev = n


def test_rank_select_is_exact(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([5.0, 5.0, rng.random() * 100])) for k in subjects(900, rng)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.lo, r.hi) for r in o.rank_select(df, ["k"], "v", {"lo": F.expr("(n - 1) div 2"), "hi": F.expr("n div 2")}, 10.0).collect()}
    for key in {k for k, _ in rows}:
        mine = sorted(v for k, v in rows if k == key)
        assert got[key] == (mine[(len(mine) - 1) // 2], mine[len(mine) // 2])


@pytest.mark.parametrize("bits", [7, 12])
def test_rank_select_over_values_of_any_size(spark, bits):
    value = F.when(F.col("id") % 5 == 0, -F.col("id") * F.col("id")).when(F.col("id") % 7 == 0, F.lit(3)).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**9)) * 1_000_003)
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), value.alias("v"))
    ranks = {"first": F.lit(0), "low": F.expr("(n - 1) div 2"), "high": F.expr("n div 2"), "late": F.expr("n * 9 div 10"), "last": F.expr("n - 1"), "beyond": F.expr("n")}
    got = {r.k: r for r in o.rank_select(df, ["k"], "v", ranks, 4096, bits).collect()}
    rows = df.collect()
    for key in range(3):
        mine = sorted(r.v for r in rows if r.k == key)
        n = len(mine)
        want = [mine[i] for i in (0, (n - 1) // 2, n // 2, n * 9 // 10, n - 1)] + [None]
        assert list(got[key])[1:] == want
    assert o.rank_select(df.limit(0), ["k"], "v", ranks, 4096, bits).count() == 0


def test_no_window_of_a_rank_sees_many_counts(spark):
    seen = []
    df = spark.range(50_000).select(F.lit("hot").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10**9))).alias("v"))
    got = o.rank_select(df, ["k"], "v", {"mid": F.expr("n div 2")}, 64, 6).first().mid
    assert got == sorted(r.v for r in df.collect())[25_000]
    # All rows of one key: the largest group a window sorts is one level's digits below one parent.
    for step in range(0, 30, 6):
        digits = df.select(F.shiftright(F.floor(F.col("v") / 64), step).alias("d")).distinct()
        seen.append(digits.groupBy(F.shiftright("d", 6)).count().agg(F.max("count")).first()[0])
    assert max(seen) <= 64


def test_top_per_group_is_exact(spark):
    rng = random.Random(4)
    rows = [(k, n, rng.randint(0, 50)) for n, k in enumerate(subjects(2000, rng))]
    df = spark.createDataFrame(rows, "k string, id long, v long")
    got = o.top_per_group(df, ["k"], [F.desc("v"), F.asc("id")], 7).collect()
    for key in {k for k, _, _ in rows}:
        mine = sorted(((-v, n) for k, n, v in rows if k == key))[:7]
        assert sorted(r.id for r in got if r.k == key) == sorted(n for _, n in mine)


def test_halo_pieces_hold_their_neighbours(spark):
    df = spark.range(50).withColumnRenamed("id", "i")
    rows = o.halo(df, "i", F.lit(10), before=F.lit(3), after=F.lit(2)).collect()
    for piece in range(5):
        low, high = piece * 10, piece * 10 + 9
        want = set(range(max(0, low - 3), min(49, high + 2) + 1))
        assert {r.i for r in rows if r.piece == piece} == want
        assert {r.i for r in rows if r.piece == piece and r.core} == set(range(low, high + 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_interval_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    spans = []
    for n, k in enumerate(subjects(300, rng)):
        start = None if rng.random() < 0.05 else float(rng.randint(0, 3000))
        end = None if start is None or rng.random() < 0.2 else start + rng.choice([0, 1, 30, 900])
        spans.append((k, n, start, end))
    points = [(k, n, float(rng.randint(-20, 4000))) for n, k in enumerate([*subjects(800, rng), "alone"])]
    left = spark.createDataFrame(points, "k string, pid long, t double")
    right = spark.createDataFrame(spans, "k string, id long, s double, e double")
    got = {r.pid: (r.gap, r.matched_id) for r in iv.nearest_interval(left, right, "k", "t", "s", "e", "id").collect()}
    assert len(got) == len(points)
    for k, pid, t in points:
        near = [
            (max(s - t, t - (s if e is None else e), 0.0), -(s if e is None else e), n)
            for kk, n, s, e in spans
            if kk == k and s is not None
        ]
        assert got[pid] == ((min(near)[0], min(near)[2]) if near else (None, None))


def test_pairs_of_one_crowded_subject_stay_single(spark):
    """Many recordings over many readings at one time: one row per reading, not one per pair."""
    spans = spark.range(2000).select(F.lit("hot").alias("k"), "id", F.lit(0.0).alias("s"), F.lit(100.0).alias("e"))
    points = spark.range(2000).select(F.lit("hot").alias("k"), F.col("id").alias("pid"), F.lit(50.0).alias("t"))
    out = iv.containing_interval(points, spans, "k", "t", "s", "e", "id")
    assert out.count() == 2000 and {r.session_id for r in out.select("session_id").distinct().collect()} == {0}


@pytest.mark.parametrize("seed", [3, 4])
def test_containing_interval_names_the_smallest_id(spark, seed):
    rng = random.Random(seed)
    spans = []
    for n, k in enumerate(subjects(400, rng)):
        start = None if rng.random() < 0.03 else float(rng.randint(0, 3000))
        end = None if start is None or rng.random() < 0.1 else start + rng.choice([-5, 0, 1, 30, 500, 2500])
        spans.append((k, rng.randint(0, 10_000), start, end))
    spans += [("all", n, 0.0, 4000.0) for n in range(50, 90)]  # equal, and nested with the next
    spans += [("all", 5, 100.0, 200.0), ("all", 3, 120.0, 130.0), ("all", 4, 125.0, 300.0)]
    points = [(k, n, float(rng.randint(-300, 6000)) / 2) for n, k in enumerate([*subjects(900, rng), *["all"] * 500, "alone"])] + [("all", -1, None)]
    left = spark.createDataFrame(points, "k string, pid long, t double")
    right = spark.createDataFrame(spans, "k string, id long, s double, e double")
    got = {r.pid: r.session_id for r in iv.containing_interval(left, right, "k", "t", "s", "e", "id", 15.0).collect()}
    want = {}
    for k, pid, t in points:
        near = [(max(s - t, t - max(s, s if e is None else e), 0.0), n) for kk, n, s, e in spans if t is not None and kk == k and s is not None]
        if near and min(near)[0] <= 15:
            want[pid] = min(near)[1]
    assert got == want and len(want) > 800
    inside = {r.pid: r.session_id for r in iv.smallest_containing(left, right, "k", "t", "s", "e", "id").collect()}
    assert len(inside) == len(points) and inside[-1] is None


def test_no_task_holds_a_crowded_node(spark):
    spans = spark.range(3000).selectExpr("'hot' k", "3000 - id id", "0D s", "1e6D e")
    points = spark.range(3000).selectExpr("'hot' k", "id pid", "cast(id as double) t")
    out = iv.smallest_containing(points, spans, "k", "t", "s", "e", "id")
    assert out.count() == 3000 and out.select("session_id").distinct().collect()[0][0] == 1
    assert iv.smallest_containing(points.limit(0), spans, "k", "t", "s", "e", "id").count() == 0
    assert iv.smallest_containing(points, spans.limit(0), "k", "t", "s", "e", "id").where("session_id is null").count() == 3000


@pytest.mark.parametrize("keys", [["k"], []])
def test_band_average_equals_brute_force(spark, keys):
    rng = random.Random(8)
    values = [(k, rng.randint(0, 4000) / 2, float("nan") if rng.random() < 0.01 else rng.randint(0, 999) / 10) for k in subjects(900, rng)]
    points = [(k, n, rng.randint(0, 4000) / 2) for n, k in enumerate(subjects(400, rng))]
    left = spark.createDataFrame(points, "k string, pid long, t double")
    right = spark.createDataFrame(values, "k string, vt double, hr double")
    for skip in (False, True):
        got = {r.pid: r.hr for r in iv.band_average(left, right, keys, "pid", "t", "vt", ["hr"], 3.0, skip).collect()}
        for k, pid, t in points:
            near = [h for kk, vt, h in values if (not keys or kk == k) and abs(vt - t) <= 3]
            near = [h for h in near if h == h] if skip else near
            want = sum(near) / len(near) if near else None
            if want is None:
                assert got[pid] is None
            elif want != want:
                assert got[pid] != got[pid]
            else:
                assert got[pid] == pytest.approx(want, abs=1e-9)


def test_gap_runs_equals_loop(spark):
    rng = random.Random(9)
    rows = [(k, float(rng.randint(0, 9000))) for k in subjects(600, rng)]
    df = spark.createDataFrame(rows, "k string, ts double")
    got = o.gap_runs(df, ["k"], "ts", 12.0).groupBy("k", "run").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("c")).collect()
    for key in {k for k, _ in rows}:
        ts = sorted(t for k, t in rows if k == key)
        runs = [[ts[0]]]
        for a, b in zip(ts, ts[1:]):
            runs.append([b]) if b - a > 12 else runs[-1].append(b)
        mine = sorted((r.a, r.b, r.c) for r in got if r.k == key)
        assert mine == sorted((r[0], r[-1], len(r)) for r in runs)
