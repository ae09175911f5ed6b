"""Near-duplicate vectors by counting collisions on many one-dimensional projections.

Vectors are compared only with those of equal label. Unit vectors are projected on orthogonal
random directions. The first projection is sorted and cut into cells as wide as its window, so what lies in a
query's window is in its own cell or beside it. On each of the other projections the
vectors within a window centred on the query collide with it; pairs that collide often enough
are verified by their cosine in double precision. Window and count are chosen so that a pair
at the threshold passes with probability ``RECALL``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wavecohort.llm.anchors import linked
from wavecohort.llm.blocks import batch
from wavecohort.llm.graph import components
from wavecohort.session import durable

COSINE = 0.98
RECALL = 0.9999
PROJECTIONS = 16
#: Half a window, in standard deviations of the difference of a pair at the threshold.
HALF = 2.0
FIRST_HALF = 4.5
#: Queries of one cell compared in one go; a fuller cell is split.
QUERIES = 512
SEED = 20


def least_count(n: int, p: float, recall: float) -> int:
    """The largest count that ``n`` draws of probability ``p`` reach with probability ``recall``."""
    reach = 0.0
    for k in range(n, 0, -1):
        reach += comb(n, k) * p**k * (1 - p) ** (n - k)
        if reach >= recall:
            return k
    return 0


@dataclass
class Projections:
    """Directions, windows and the count that a pair has to reach, for vectors of one length."""

    length: int
    cosine: float = COSINE
    directions: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        draw = np.random.Generator(np.random.PCG64(SEED + self.length))
        n = min(self.length, PROJECTIONS + 1)
        self.directions = np.linalg.qr(draw.standard_normal((self.length, n)))[0]
        # A difference of this length spreads evenly over the directions of the space.
        apart = sqrt(2 - 2 * self.cosine)
        step = apart / sqrt(self.length)
        self.cell = min(apart, FIRST_HALF * step)
        self.half = min(apart, HALF * step)
        p = 1.0 if self.half >= apart else erf(HALF / sqrt(2)) * 0.99  # short vectors are a little less even
        self.count = least_count(n - 1, p, RECALL)

    def of(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.directions


def unit_vectors(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, flat values and a flag per row: finite in all components and not zero."""
    values = [np.asarray(x.values.to_numpy(zero_copy_only=False), float) if x.is_valid else np.empty(0) for x in lists]
    good = np.array([bool(len(v)) and bool(np.isfinite(v).all()) and bool(np.any(v)) for v in values], bool)
    return np.array([len(v) for v in values], np.int64), values, good


def _placed(cosine: float):
    """Per class: the cells it is sent to, its unit vector and its projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Projections] = {}
        for b in batches:
            lengths, values, good = unit_vectors(b.column(2))
            for n in np.unique(lengths[good]).tolist():
                rows = np.flatnonzero(good & (lengths == n))
                use = known.setdefault(n, Projections(n, cosine))
                x = np.stack([values[r] for r in rows])
                x /= np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                p = use.of(x)
                cell = np.floor(p[:, 0] / use.cell).astype(np.int64)
                for beside in (-1, 0, 1):
                    yield batch(
                        label=b.column(1).take(pa.array(rows)),
                        length=np.full(len(rows), n, np.int32),
                        cell=cell + beside,
                        query=np.full(len(rows), beside == 0),
                        id=b.column(0).take(pa.array(rows)),
                        weight=b.column(3).take(pa.array(rows)),
                        unit=pa.array([v.tobytes() for v in x], pa.binary()),
                        sorted_by=p[:, 0],
                        others=pa.array([v.tobytes() for v in p[:, 1:].astype(np.float32)], pa.binary()),
                    )

    return run


def passed(held: dict, rows: dict, use: Projections, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Count the links of the held queries from ``first`` on with some rows, and give links that connect them."""
    window = np.float32(use.half * (1 + 1e-6))
    queries = {k: v[first:] for k, v in held.items()}
    for i in range(0, len(rows["id"]), QUERIES):
        part = {k: v[i : i + QUERIES] for k, v in rows.items()}
        q, o = np.nonzero(np.abs(queries["first"][:, None] - part["first"][None, :]) <= use.cell)
        hits = np.zeros(len(q), np.int16)
        for k in range(part["others"].shape[1]):
            hits += np.abs(queries["others"][q, k] - part["others"][o, k]) <= window
        often = hits >= use.count
        q, o = q[often], o[often]
        exact = np.einsum("ij,ij->i", queries["unit"][q], part["unit"][o]) >= use.cosine
        exact &= queries["id"][q] != part["id"][o]
        q, o = q[exact], o[exact]
        if len(q):
            np.add.at(queries["links"], q, part["weight"][o])  # a view of what is held
            matches = np.zeros((len(queries["id"]), len(part["id"])), bool)
            matches[q, o] = True
            a, b = linked(matches, queries["id"], part["id"])
            yield batch(a=a, b=b, n=np.zeros(len(a), np.int64))


def _compare(cosine: float):
    """Rows sorted by (label, length, cell, part, queries first) to links and, per query, the weight it links to.

    Only the queries of one part are held; what passes by them comes in batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, use, held = None, None, None

        def counts() -> Iterator[pa.RecordBatch]:
            if held and len(held["id"]):
                none = pa.nulls(len(held["id"]), pa.int64())
                yield batch(a=held["id"], b=none, n=held["links"])

        for b in batches:
            keys = list(zip(*[b.column(n).to_pylist() for n in ("label", "length", "cell", "part")]))
            cut = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            for s, e in zip(cut, cut[1:]):
                if s == e:
                    continue
                some = b.slice(s, e - s)
                now = {
                    "id": some.column("id").to_numpy(),
                    "weight": some.column("weight").to_numpy(),
                    "first": some.column("sorted_by").to_numpy(),
                    "unit": np.frombuffer(b"".join(some.column("unit").to_pylist())).reshape(e - s, -1),
                    "others": np.frombuffer(b"".join(some.column("others").to_pylist()), np.float32).reshape(e - s, -1),
                }
                query = some.column("query").to_numpy(zero_copy_only=False)
                own = {k: v[query] for k, v in now.items()} | {"links": np.zeros(query.sum(), np.int64)}
                if keys[s] == at:
                    # Queries that an earlier batch brought have passed already, but not by the new ones.
                    before, first = held, len(held["id"])
                    held = {k: np.concatenate((held[k], own[k])) for k in own}
                    if len(own["id"]) and first:
                        yield from passed(held, before, use, first)
                else:
                    yield from counts()
                    at, use, held = keys[s], Projections(keys[s][1], cosine), own
                if len(held["id"]):
                    yield from passed(held, now, use)
        yield from counts()

    return run


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id
    reachable. Rows with equal label and vector are one class and link to each other, without
    pairs of them being made. Vectors that are null, empty or zero or hold null or non-finite
    components, and rows without label, link with nothing; so do vectors of different length.
    Rows that repeat a vec_id are counted like any others; rows without one link but name no
    component. An empty table gives an empty one; other columns are ignored.
    """
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v")
    )
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("label").isNotNull() & F.coalesce(~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("id", F.when(usable, F.xxhash64("label", "v")))
    good = rows.where("id is not null")
    classes = good.groupBy("id").agg(
        F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.count("*").alias("weight"), F.min("vec_id").alias("least")
    )
    classes = durable(classes, "classes")

    kind = classes.schema["label"].dataType.simpleString()
    columns = "id long, weight long, unit binary, sorted_by double, others binary"
    placed = classes.select("id", "label", "v", "weight").mapInArrow(
        _placed(cosine), f"label {kind}, length int, cell long, query boolean, {columns}"
    )
    placed = durable(placed, "cells")
    cell = ["label", "length", "cell"]
    full = placed.where("query").groupBy(*cell).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    full = durable(full.where("parts > 1"), "full")
    own = F.pmod(F.col("id"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    dealt = placed.join(full, cell, "left").select(*placed.columns, own.alias("own"), parts.alias("part"))
    dealt = dealt.withColumn("query", F.col("query") & (F.col("own") == F.col("part"))).drop("own")
    ready = dealt.repartition(*cell, "part").sortWithinPartitions(*cell, "part", F.desc("query"))
    found = durable(ready.mapInArrow(_compare(cosine), "a long, b long, n long"), "links")

    reach = components(found.where("b is not null")).withColumnRenamed("node", "id")
    links = found.where("b is null").select(F.col("a").alias("id"), "n")
    classes = classes.drop("label", "v").join(links, "id", "left").join(reach, "id", "left")
    classes = classes.withColumn("component", F.coalesce("component", "id"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    number = (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    named = durable(classes.join(least, "component").select("id", number, "component_id"), "named")
    out = rows.select("vec_id", "id").join(named, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
