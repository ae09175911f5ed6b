"""Vector near-duplicates against all pairs."""

import math

import numpy as np
import pytest

from wavecohort.llm import collide

SCHEMA = "vec_id long, embedding array<float>, label int, id string, cell string, part string"


def table(sent, rows):
    return sent.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    unit = []
    for _, v, label in rows:
        x = np.array(v if v else [], float) if v is not None and None not in v else np.empty(0)
        good = label is not None and len(x) and np.isfinite(x).all() and np.any(x)
        unit.append(x / np.linalg.norm(x) if good else None)
    close = lambda a, b: (
        unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98
    )
    links = [[b for b in range(len(rows)) if b != a and close(a, b)] for a in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        for a, found in enumerate(links):
            for b in found:
                label[a] = label[b] = min(label[a], label[b])
    least = {}
    for (i, _, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted((str(r[0]), len(found), str(least.get(c))) for r, found, c in zip(rows, links, label))


@pytest.mark.parametrize("length", [2, 64])
def test_links_and_components(sent, monkeypatch, length):
    monkeypatch.setattr(collide, "QUERIES", 16)  # cells are split
    draw = np.random.default_rng(length)
    rows = []
    for i in range(150):
        x = draw.standard_normal(length)
        rows.append((len(rows), x.tolist(), i % 3))
        for _ in range(i % 4):
            y = x + draw.standard_normal(length) * draw.choice([0.05, 0.12, 0.2]) * np.linalg.norm(x) / math.sqrt(length)
            rows.append((len(rows), y.tolist(), i % 3))
    hot = draw.standard_normal(length).tolist()
    rows += [(len(rows) + k, hot, 1) for k in range(40)] + [(900, (np.array(hot) * 3).tolist(), 1)]
    rows = [(i, np.array(v, np.float32).tolist(), n) for i, v, n in rows]
    rows += [(901, None, 1), (902, [], 1), (903, [0.0] * length, 1), (904, [float("nan")] * length, 1), (905, [1.0] * length, None)]
    rows += [(906, [float("inf")] + [1.0] * (length - 1), 1), (907, [None] + [1.0] * (length - 1), 1), (908, [1.0] * (length + 1), 1)]
    rows += [(None, hot, 1), (3, hot, 1), (909, [1e-30] * length, 2), (910, [1e30] * length, 2)]
    got = collide.near_vectors(table(sent, rows)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_empty(sent):
    assert collide.near_vectors(table(sent, [])).count() == 0


def test_count_reaches_the_recall():
    assert collide.least_count(10, 1.0, 0.9999) == 10
    use = collide.Projections(64)
    draw = np.random.default_rng(1)
    x = draw.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = draw.standard_normal((4000, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z
    apart = np.abs(use.of(x) - use.of(y))
    passed = ((apart[:, 1:] <= use.half).sum(axis=1) >= use.count) & (apart[:, 0] <= use.cell)
    assert passed.mean() > 0.999


def test_batches_that_cut_a_cell_lose_no_link(sent, monkeypatch):
    before = sent.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sent.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        draw = np.random.default_rng(8)
        x = draw.standard_normal(16)
        rows = [(i, (x + draw.standard_normal(16) * 0.12).astype(np.float32).tolist(), 1) for i in range(60)]
        got = collide.near_vectors(table(sent, rows)).collect()
    finally:
        sent.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)
    assert sum(r.n_links for r in got) > 100
