"""Samples stored in slices: the same results as unordered ones, and no shuffle by range."""

import random

import numpy as np
from pyspark.sql import functions as F

from wavecohort.operators import signal as s
from wavecohort.sources.samples import SampleTable

KEY = ["session_id"]
KIND = "session_id long, timestamp_ns long, x double"


def recordings(spark):
    rng = np.random.default_rng(5)
    rows = [(sid, int(t) * 10_000_000, float(rng.normal())) for sid, n in ((1, 4000), (2, 30), (3, 1)) for t in range(n)]
    rows += [(2, None, 1.0), (4, None, 2.0)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, KIND)


def stored(spark, tmp_path, rows, batches=3):
    table = SampleTable(spark, str(tmp_path / "samples"), rows.schema, buckets=4, slice_ns=3 * 10**9)
    for n in range(batches):
        table.append(rows.where(F.pmod(F.xxhash64("timestamp_ns", "session_id"), F.lit(batches)) == n))
    return table


def known(df):
    return sorted((r.session_id, r.i, r.n, r.t_s, round(r.fs, 9), r.x) for r in df.collect())


def test_index_and_rates_of_stored_samples(spark, tmp_path):
    rows = recordings(spark).where("timestamp_ns IS NOT NULL")
    table = stored(spark, tmp_path, rows)
    assert known(s.sample_index(table.read(), KEY, ["x"])) == known(s.sample_index(rows, KEY, ["x"]))
    rates = lambda df: sorted(map(tuple, s.sample_rates(df, KEY).collect()))
    assert rates(table.read()) == rates(rows)


def test_samples_without_time_come_first(spark, tmp_path):
    got = s.sample_index(stored(spark, tmp_path, recordings(spark)).read(), KEY)
    first = {r.session_id: r.timestamp_ns for r in got.where("i = 0").collect()}
    assert first == {1: 0, 2: None, 3: 0, 4: None}
    assert got.count() == 4033


def test_nothing_is_dealt_by_range(spark, tmp_path):
    table = stored(spark, tmp_path, recordings(spark))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = table.read()
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        plan = s.sample_index(read, KEY, ["x"])._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_long_recording_spreads_and_an_empty_table_reads(spark, tmp_path):
    rows = recordings(spark).where("session_id = 1")
    table = stored(spark, tmp_path, rows, 1)
    assert table.read().select(F.spark_partition_id()).distinct().count() == 4
    assert table.read().agg(F.max("_pos")).first()[0] == 299
    empty = SampleTable(spark, str(tmp_path / "none"), rows.schema, buckets=4)
    assert empty.read().count() == 0


def test_another_session_opens_the_folder(spark, tmp_path):
    rows = recordings(spark)
    table = stored(spark, tmp_path, rows)
    before = sorted(map(str, table.read().collect()))
    table.forget()
    assert sorted(map(str, table.read().collect())) == before and len(before) == rows.count()
