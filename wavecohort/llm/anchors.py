"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two documents link when at most ``LINK`` bits differ. The bits
are cut into fields. Each field has its own covering code: the binary Golay code on 23 bits
(every word is within 3 bits of a code word) with free bits added, or, for the exact field,
all words. Thresholds ``t`` of the fields are such that two linked fingerprints differ by at
most ``t`` in at least one field. In that field a fingerprint's *home* is its nearest anchor,
at most R away, and the other one is at most R + t away from it. So every fingerprint is sent
to all anchors within R + t, and homes are compared with all that arrive at their anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from wavecohort.llm.blocks import batch, blocks, signed
from wavecohort.llm.graph import components
from wavecohort.session import durable

LINK = 4
WORDS = 4
SEED = 42
#: Homes of one anchor compared in one go; a fuller anchor is split.
HOMES = 1024


@dataclass(frozen=True)
class Field:
    """``width`` bits from ``low`` up, covered to radius ``radius``; ``t`` bits may differ."""

    low: int
    width: int
    radius: int
    t: int

    @cached_property
    def _columns(self) -> np.ndarray:
        """The syndrome of each single bit: of the Golay code on the lowest 23, none above."""
        generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, fixed
        out = np.zeros(self.width, np.uint32)
        if self.radius == 3:
            x = 1
            for bit in range(23):
                out[bit] = x
                x <<= 1
                if x >> 11:
                    x ^= generator
        return out

    @cached_property
    def table(self) -> np.ndarray:
        """Per syndrome, the error patterns of weight up to radius + t, the lightest first; padded with -1."""
        if not self.radius:
            return np.zeros((1, 1), np.int64)
        rows: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(self.radius + self.t + 1):
            for bits in combinations(range(self.width), weight):
                s = int(np.bitwise_xor.reduce(self._columns[list(bits)])) if bits else 0
                rows[s].append(sum(1 << b for b in bits))
        # The home is the pattern of the code on 23 bits alone: the only one of weight <= 3 there.
        rows = [sorted(r, key=lambda e: (e >> 23 != 0, e.bit_count())) for r in rows]
        out = np.full((2048, max(map(len, rows))), -1, np.int64)
        for s, r in enumerate(rows):
            out[s, : len(r)] = r
        return out

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and anchors (the code word itself); the first anchor of each row is its home."""
        word = ((fp >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)).astype(np.int64)
        if self.radius:
            syndrome = np.zeros(len(fp), np.uint32)
            for bit in range(23):
                syndrome ^= np.where((word >> bit) & 1, self._columns[bit], 0).astype(np.uint32)
            errors = self.table[syndrome]
        else:
            errors = np.zeros((len(fp), 1), np.int64)
        row, n = np.nonzero(errors >= 0)
        return row, n == 0, word[row] ^ errors[row, n]


#: sum(t + 1) over the fields is LINK + 1, so some field always differs by t or less.
FIELDS = (Field(0, 26, 3, 1), Field(26, 26, 3, 1), Field(52, 12, 0, 0))


def simhash(shingles: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per text, the bits set in more than half of its shingle hashes."""
    out = np.zeros(len(first), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        bits = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, first[full], axis=0, dtype=np.int32)
        major = np.packbits(sums * 2 > count[full, None], axis=1)
        out[full] = major.view(">u8").ravel()
    return out


def text_fingerprints(column: pa.Array, words: int = WORDS) -> np.ndarray:
    """Fingerprint of every text of a column."""
    digest, done = xxhash.xxh64_intdigest, [np.empty(0, np.uint64)]
    for raw in blocks(column):
        block = raw.lowered()
        text, starts, ends = block.spaced
        n = np.diff(block.first_word)
        count = np.where(n == 0, 0, np.maximum(1, n - words + 1))
        first = np.cumsum(count) - count
        at = np.repeat(block.first_word[:-1] - first, count) + np.arange(count.sum())
        last = np.minimum(at + words, np.repeat(block.first_word[1:], count)) - 1
        hashes = [digest(text[s:e], SEED) for s, e in zip(starts[at].tolist(), ends[last].tolist())]
        done.append(simhash(np.array(hashes, np.uint64), first, count))
    return np.concatenate(done)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (64 bits as a long) for every row; null, empty and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(doc_id=b.column(0), fp=signed(text_fingerprints(b.column(1))))

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, fp long")


def _spread(fields: tuple[Field, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for number, field in enumerate(fields):
                row, home, anchor = field.anchors(fp)
                yield batch(anchor=anchor | (number << 60), home=home, fp=signed(fp[row]))

    return run


def linked(matches: np.ndarray, homes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the components of a matrix of matches (homes x others); no more than its rows and columns."""
    label = np.arange(len(homes))
    while True:
        best = np.where(matches, label[:, None], len(homes)).min(axis=0, initial=len(homes))
        lower = np.where(matches, best[None, :], len(homes)).min(axis=1, initial=len(homes))
        lower = np.minimum(label, lower)
        if (lower == label).all():
            break
        label = lower[lower]
    hit = best < len(homes)
    moved = label != np.arange(len(homes))
    return (
        np.concatenate((homes[label[moved]], homes[best[hit]])),
        np.concatenate((homes[moved], others[hit])),
    )


def compare_anchors(batches: Iterator[pa.RecordBatch], link: int = LINK) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, part, home first) to links. Only the homes of one part are held."""
    at, homes = None, np.empty(0, np.uint64)
    for b in batches:
        if not b.num_rows:
            continue
        anchor, part = b.column(0).to_numpy(), b.column(1).to_numpy()
        home, fp = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy().view(np.uint64)
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
        found_a, found_b = [], []
        for s, e in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(fp)])).tolist()):
            own = fp[s:e][home[s:e]]
            homes = np.concatenate((homes, own)) if at == (anchor[s], part[s]) else own
            at = (anchor[s], part[s])
            if not len(homes) or len(homes) + e - s == 2:
                continue
            for i in range(s, e, 4096):
                some = fp[i : min(e, i + 4096)]
                near = np.bitwise_count(homes[:, None] ^ some[None, :]) <= link
                if near.sum() > (homes[:, None] == some[None, :]).sum():
                    a, c = linked(near, homes, some)
                    found_a.append(a[a != c])
                    found_b.append(c[a != c])
        if found_a:
            yield batch(a=signed(np.concatenate(found_a)), b=signed(np.concatenate(found_b)))


def fingerprint_links(distinct: DataFrame, fields: tuple[Field, ...] = FIELDS, homes: int = HOMES) -> DataFrame:
    """Links ``a, b`` with the same components as all pairs of fingerprints within the threshold.

    ``distinct`` has one column ``fp`` without repeats. An anchor with more than ``homes``
    homes is split: each part has its share of the homes and sees all arrivals.
    """
    spread = durable(distinct.select("fp").mapInArrow(_spread(fields), "anchor long, home boolean, fp long"), "anchors")
    crowded = spread.where("home").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > homes)
    parts = crowded.select("anchor", F.ceil(F.col("n") / homes).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")
    placed = spread.join(parts, "anchor", "left").select(
        "anchor",
        "fp",
        "home",
        own.alias("own"),
        F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"),
    )
    placed = placed.select("anchor", "part", (F.col("home") & (F.col("own") == F.col("part"))).alias("home"), "fp")
    ready = placed.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"))
    return ready.mapInArrow(compare_anchors, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    The component is the smallest doc_id reachable over links, the row's own included. Equal
    fingerprints are one node, so copies never meet in pairs. Null, empty and blank texts have
    fingerprint zero and link like any other; rows that repeat a doc_id each have a row; rows
    without doc_id link too, and a component of such rows alone has no id. An empty table
    gives an empty one; other columns are ignored.
    """
    prints = durable(fingerprints(docs, doc_id, text), "fingerprints")
    named = durable(_least(prints, F.col("doc_id")).withColumnRenamed("least", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _least(prints: DataFrame, value: Column) -> DataFrame:
    """``fp, least`` for every fingerprint: the smallest ``value`` of all rows of its component."""
    nodes = durable(prints.groupBy("fp").agg(F.min(value).alias("least")), "nodes")
    reach = components(fingerprint_links(nodes)).withColumnRenamed("node", "fp")
    own = nodes.join(reach, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = own.groupBy("component").agg(F.min("least").alias("least"))
    return own.drop("least").join(least, "component").select("fp", "least")


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id.

    Every row is a document of its own, also rows that repeat an id and rows without id.
    Among rows of one id a hash of the text decides; rows without id come last.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.monotonically_increasing_id().alias("key"), rest.alias("rest"))
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(key=b.column(0), rest=b.column(1), fp=signed(text_fingerprints(b.column(1).field(where))))

    kind = rows.schema["rest"].dataType.simpleString()
    rows = durable(rows.mapInArrow(run, f"key long, rest {kind}, fp long"), "rows")
    own, words = F.col(f"rest.`{doc_id}`"), F.col(f"rest.`{text}`")
    place = F.struct(own.isNull().alias("last"), own.alias("doc_id"), F.xxhash64(words).alias("version"), "key")
    kept = _least(rows, place).select(F.col("least.key").alias("key")).distinct()
    stay = rows.join(durable(kept, "kept"), "key", "left_semi")
    return stay.select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
