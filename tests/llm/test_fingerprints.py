"""Threshold sketches: edited texts, likeness and order against plain Python."""

import hashlib

from pyspark.sql import functions as F

from wavecohort.llm import fingerprints as fp


def check(spark, make, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = fp.edited_fingerprints(make(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    low = float("-inf")
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (low if r[0] is None else r[0], r[1].encode()), reverse=True)
    wanted = []
    for n, (i, t) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        wanted.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(wanted)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next, r.contained_edited))
    return got


def test_order_and_edits(sent, make, odd):
    got = check(sent, make, odd, 8)
    repeated = {(r.doc_id, r.fingerprint) for r in got if r.doc_id == 13}
    assert len(repeated) == 1 and next(r for r in got if r.doc_id == 11).fingerprint == repeated.pop()[1]
    check(sent, make, odd, 1)
    check(sent, make, [(3, "only one here of all the words")], 8)


def test_sparse_ids(sent, make):
    rows = [(i * i * 1_000_003, f"text number {i} has a few words more than {i % 7}") for i in range(80)]
    check(sent, make, rows, 8)


def test_likeness_and_containment(sent):
    words = [f"w{i}" for i in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    part = " ".join(words[:1000])
    table = sent.createDataFrame([(a, b, part, a.upper())], "a string, b string, part string, big string")
    table = table.select(*[fp.fingerprint(F.col(c)).alias(c) for c in table.columns])
    r = table.select(
        fp.likeness(F.col("a"), F.col("b")).alias("ab"),
        fp.containment(F.col("part"), F.col("a")).alias("inside"),
        fp.containment(F.col("a"), F.col("part")).alias("over"),
        fp.likeness(F.col("a"), F.col("big")).alias("same"),
        fp.likeness(fp.merged(F.col("a"), F.col("part")), F.col("a")).alias("merged"),
    ).first()
    assert abs(r.ab - 1 / 3) < 0.05 and r.inside == 1 and abs(r.over - 0.25) < 0.06 and r.same == 1 and r.merged == 1


def test_small_texts_keep_a_hash(sent):
    rows = [(t,) for t in ("", "one", "one two three", "a b c d e f")]
    got = sent.createDataFrame(rows, "t string").select("t", fp.fingerprint(F.col("t")).alias("s")).collect()
    assert all((len(r.s) > 0) == bool(r.t) for r in got)


def test_empty(make):
    assert fp.edited_fingerprints(make([])).count() == 0


def test_no_python_in_the_plan(make, odd):
    plan = fp.edited_fingerprints(make(odd))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
