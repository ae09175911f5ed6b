"""Packing token sequences by best-two-fit.

Lengths are small integers, so the packing is found for the counts of each length: a bin is
filled greedily with the longest piece that still fits, then its shortest piece is replaced by
the two unpacked pieces that fill the gap best, if they fill it better. The same bin is
repeated while its pieces last, which gives what packing bin by bin gives. The plan has a few
thousand kinds of bins at most, whatever the number of documents; each piece finds its place
by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wavecohort.llm.blocks import batch
from wavecohort.llm.bytebpe import encoder as shared_encoder
from wavecohort.session import durable

CAPACITY = 1024
END = 2
#: Texts encoded together.
TEXTS = 256


def best_two(count: np.ndarray, room: int) -> tuple[int, int]:
    """The two available lengths with the largest sum that fits into ``room``; (0, 0) if there are none."""
    have = np.flatnonzero(count[: room + 1])
    if not len(have):
        return 0, 0
    second = np.searchsorted(have, np.minimum(room - have, have), side="right") - 1
    alone = (second >= 0) & (have[second] == have) & (count[have] < 2)
    second = np.where(alone, second - 1, second)
    ok = second >= 0
    if not ok.any():
        return 0, 0
    first, other = have[ok], have[second[ok]]
    best = int(np.argmax(first + other))
    return int(first[best]), int(other[best])


def plan(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Kinds of bins (lengths in order) with how often each is used; ``count[n]`` pieces have length n."""
    left, bins = count.astype(np.int64).copy(), []
    while (have := np.flatnonzero(left)).size:
        used, room = [], capacity
        while len(fits := have[: np.searchsorted(have, room, side="right")]):
            used.append(int(fits[-1]))
            room -= used[-1]
            left[used[-1]] -= 1
            have = np.flatnonzero(left[: room + 1])
        if len(used) > 1:
            first, other = best_two(left, room + used[-1])
            if first + other > used[-1]:
                left[used.pop()] += 1
                used += [first, other]
                left[first] -= 1
                left[other] -= 1
        kinds, need = np.unique(used, return_counts=True)
        more = int((left[kinds] // need).min())
        left[kinds] -= more * need
        bins.append((used, 1 + more))
    return bins


def places(bins: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ranks as sorted arrays: length, first rank, first sequence and offset of each run."""
    rows, sequence, taken = [], 0, {}
    for used, times in bins:
        at = 0
        for n in used:
            rows.append((n, taken.get(n, 0), sequence, at))
            taken[n] = taken.get(n, 0) + times
            at += n
        sequence += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.empty(0, np.int64),) * 4


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of ``n`` tokens; only the first may be shorter than the capacity if there are several."""
    whole, rest = divmod(n, capacity)
    return [rest] * (rest > 0) + [capacity] * whole


def cut_pieces(size: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, number, start and length of every piece of documents of ``size`` tokens, cut as ``cut_lengths`` does."""
    many = -(-size // capacity)
    row = np.repeat(np.arange(len(size)), many)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    head = size - (many - 1) * capacity
    start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
    return row, piece, start, np.where(piece == 0, head[row], capacity)


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()
) -> DataFrame:
    """One row per piece, with its rank ``r`` among the pieces of its length in the task ``part``, and columns ``also`` of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ranks = shared_encoder(path), np.zeros(capacity + 1, np.int64)
        part, end = TaskContext.get().partitionId(), np.array([END], "<u2").tobytes()
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                some = b.slice(i, TEXTS)
                raw = [ids + end for ids in encoder.encode(some.column(1).fill_null("").to_pylist())]
                size = np.array([len(x) // 2 for x in raw])
                row, piece, start, length = cut_pieces(size, capacity)
                at = (np.cumsum(size) - size)[row] + start
                ids = memoryview(np.frombuffer(b"".join(raw), "<u2").astype("<u4").tobytes())
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((at * 4).tolist(), ((at + length) * 4).tolist())]
                order = np.argsort(length, kind="stable")
                sort = length[order]
                r = np.empty(len(row), np.int64)
                r[order] = ranks[sort] + np.arange(len(row)) - np.searchsorted(sort, sort)
                ranks += np.bincount(length, minlength=capacity + 1)
                yield batch(
                    doc_id=some.column(0).take(pa.array(row)),
                    piece=piece.astype(np.int32),
                    start=start,
                    length=length,
                    ids_crc32=np.array(crc, np.int64),
                    part=np.full(len(r), part, np.int64),
                    r=r,
                    **{c: some.column(i).take(pa.array(row)) for i, c in enumerate(also, 2)},
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, r long" + _fields(docs, also)
    return docs.select(doc_id, text, *also).mapInArrow(run, schema)


def _fields(docs: DataFrame, names: tuple[str, ...]) -> str:
    return "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in names)


def packed(
    docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: every piece of every row, packed.

    ``path`` is the tokenizer's file. A null or empty text has its end token alone; rows that repeat a
    doc_id, or have none, are packed like others. Equal lengths are interchangeable, ties
    between them fall by task and row. Only one count for each length up to the capacity comes
    to the driver. An empty table gives an empty one; columns ``also`` of the document follow, others are ignored.
    """
    rows = durable(pieces(docs, path, capacity, doc_id, text, also), "pieces")
    counts = durable(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    total = np.zeros(capacity + 1, np.int64)
    for n, times in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        total[n] = times
    length, first, sequence, offset = places(plan(total, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.int64(1) << 50
        runs = length * room + first
        for b in batches:
            if not b.num_rows:
                continue
            rank = b.column("before").to_numpy() + b.column("r").to_numpy()
            run = np.searchsorted(runs, b.column("length").to_numpy() * room + rank, side="right") - 1
            kept = {n: b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            more = {n: b.column(n) for n in also}
            yield batch(**kept, sequence_id=sequence[run] + rank - first[run], offset=offset[run], **more)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + _fields(rows, also)
    return rows.join(start, ["part", "length"]).mapInArrow(place, schema)
