"""Token shards in training order.

1. Documents are encoded once, in chunks, and stored with their token counts.
2. The counts alone are sorted by doc_id and text hash; running sums, carried from range to
   range, give every document its place in the token stream of all documents. The stream is cut at
   every ``stride`` tokens, so a sequence's number does not depend on how the input is split.
3. A keyed Feistel permutation of the sequence numbers, walked until it stays in their range,
   gives each sequence its slot: random, without a drawn column, the same on every run.
4. Ranges of slots are the shards. A chunk sends each shard one row with its stretches of
   sequences there; a shard puts them in place and is written as a plain file, so a slot
   stands at a known byte and a training run goes on from any slot.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wavecohort.llm.blocks import batch, mixed
from wavecohort.llm.bytebpe import encoder as shared_encoder
from wavecohort.llm.packing import TEXTS
from wavecohort.session import durable, intermediate

STRIDE = 1024
END = 50256
KEY = 20
ROUNDS = 6
#: Bytes of ids for each shard; a writer holds one shard.
SHARD = 16 << 20
#: Bytes of ids encoded before they are stored as a chunk; a longer text is a chunk of its own.
CHUNK = 4 << 20


def slots(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0..n-1 at ``index``: a Feistel network on the next even number of bits.

    What falls outside is permuted again until it falls inside (cycle-walking).
    """
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _lists(values: pa.Array | np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values)).cast(pa.list_(pa.array(values).type))


def chunks(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``part, first, docs, versions, sizes, ids``: encoded documents, each with an end token.

    ``first`` is the number of the chunk's first document in the task ``part``; ``ids`` are compressed 16-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = shared_encoder(path), zstandard.ZstdCompressor(level=3)
        part, end = TaskContext.get().partitionId(), np.array([END], "<u2").tobytes()
        raw: list[bytes] = []
        owners: list[pa.Array] = []
        versions: list[pa.Array] = []
        held = first = 0

        def chunk() -> pa.RecordBatch:
            bounds = np.array([0, len(raw)])
            return batch(
                part=np.array([part], np.int64),
                first=np.array([first], np.int64),
                docs=_lists(pa.concat_arrays(owners), bounds),
                versions=_lists(pa.concat_arrays(versions), bounds),
                sizes=_lists(np.array([len(x) // 2 for x in raw], np.int64), bounds),
                ids=pa.array([pack.compress(b"".join(raw))], pa.binary()),
            )

        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                some = b.slice(i, TEXTS)
                more = [ids + end for ids in encoder.encode(some.column(2).fill_null("").to_pylist())]
                raw += more
                owners.append(some.column(0))
                versions.append(some.column(1))
                held += sum(map(len, more))
                if held >= CHUNK:
                    yield chunk()
                    first, held, raw, owners, versions = first + len(raw), 0, [], [], []
        if raw:
            yield chunk()

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"part long, first long, docs array<{kind}>, versions array<long>, sizes array<long>, ids binary"
    return docs.select(doc_id, F.xxhash64(text).alias("version"), text).mapInArrow(run, schema)


def offsets(stored: DataFrame, where: str) -> int:
    """Write each document's place in the stream of all tokens, a file for each part; the length of the stream.

    Documents are in order of doc_id (none first) and text hash; what is equal in both has the same
    tokens, and its order changes nothing. One sum for each range comes to the driver.
    """
    one = F.posexplode(F.arrays_zip("docs", "versions", "sizes")).alias("nth", "doc")
    rows = stored.select("part", "first", one).select(
        F.col("doc.docs").alias("doc"), F.col("doc.versions").alias("version"), "part", (F.col("first") + F.col("nth")).alias("at"), "doc.sizes"
    )
    order = ["doc", "version", "part", "at"]
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("part", "at", "sizes")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = TaskContext.get().partitionId(), 0
        for b in batches:
            size = b.column("sizes").to_numpy()
            sums = total + np.cumsum(size)
            yield batch(range=np.full(len(size), number, np.int64), part=b.column("part"), at=b.column("at"), before=sums - size, size=size)
            total = int(sums[-1]) if len(size) else total

    placed = durable(ranged.mapInArrow(running, "range long, part long, at long, before long, size long"), "offsets")
    sums = np.zeros(parts + 1, np.int64)
    for number, size in placed.groupBy("range").agg(F.sum("size")).collect():
        sums[number + 1] = size
    base = np.cumsum(sums)

    def store(key: tuple, table: pa.Table) -> pa.Table:
        at = table.column("at").to_numpy()
        place = np.empty(len(at), np.int64)
        place[at] = table.column("before").to_numpy() + base[table.column("range").to_numpy()]
        name = os.path.join(where, f"offsets-{key[0].as_py()}")
        temporary = f"{name}.{uuid.uuid4().hex}"
        place.tofile(temporary)
        os.replace(temporary, name)
        return pa.table({"part": [key[0].as_py()]})

    placed.groupBy("part").applyInArrow(store, "part long").count()
    return int(base[-1])


def stretches(start: np.ndarray, size: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents that lie one after the other here, cut where sequences end.

    ``start`` are their places in the stream. For each stretch: its sequence, its place there, its first
    token here and its length. Documents that follow each other in the stream too are one run.
    """
    here = np.cumsum(size) - size
    head = np.flatnonzero(np.concatenate(([True], start[1:] != start[:-1] + size[:-1])))
    length = np.add.reduceat(size, head)
    low = start[head] // stride
    many = (start[head] + length - 1) // stride - low + 1
    run = np.repeat(np.arange(len(head)), many)
    sequence = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    first = np.maximum(start[head][run], sequence * stride)
    last = np.minimum((start[head] + length)[run], (sequence + 1) * stride)
    return sequence, first - sequence * stride, here[head][run] + first - start[head][run], last - first


def dealt(stored: DataFrame, where: str, n: int, width: int, stride: int = STRIDE, key: int = KEY) -> DataFrame:
    """``shard, slot, at, length, owner, ids``: what a chunk sends to a shard; ``owner`` is the document at place 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for b in batches:
            for row in range(b.num_rows):
                size = b.column("sizes")[row].values.to_numpy()
                first = b.column("first")[row].as_py()
                places = np.memmap(os.path.join(where, f"offsets-{b.column('part')[row].as_py()}"), np.int64, "r")
                sequence, at, here, length = stretches(places[first : first + len(size)], size, stride)
                slot = slots(sequence, n, key)
                order = np.argsort(slot // width, kind="stable")
                slot, at, here, length = slot[order], at[order], here[order], length[order]
                shard = slot // width
                cut = np.concatenate((np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))), [len(shard)]))
                owner = np.searchsorted(np.cumsum(size), here, side="right")
                raw = memoryview(unpack.decompress(b.column("ids")[row].as_py()))
                some = [raw[s:e] for s, e in zip((here * 2).tolist(), ((here + length) * 2).tolist())]
                yield batch(
                    shard=shard[cut[:-1]].astype(np.int32),
                    slot=_lists(slot, cut),
                    at=_lists(at, cut),
                    length=_lists(length, cut),
                    owner=_lists(b.column("docs")[row].values.take(pa.array(owner)), cut),
                    ids=pa.array([pack.compress(b"".join(some[s:e])) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary()),
                )

    kind = stored.schema["docs"].dataType.elementType.simpleString()
    schema = f"shard int, slot array<long>, at array<long>, length array<long>, owner array<{kind}>, ids binary"
    return stored.select("part", "first", "docs", "sizes", "ids").mapInArrow(run, schema)


def _local(folder: str) -> str:
    at = urlparse(folder)
    if at.scheme not in ("", "file"):
        raise ValueError(f"shards are written as plain files: mount {folder} and name it as a path")
    return at.path


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def materialise(
    docs: DataFrame,
    path: str,
    folder: str | None = None,
    stride: int = STRIDE,
    shard: int = SHARD,
    key: int = KEY,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write all documents as shards; one row per sequence: ``slot, shard, byte, first_doc_id, filled, crc32``.

    ``folder`` has to be a path that all executors mount; by default a new one in the shared
    folder, which ``drop_intermediates`` removes. A shard is written under another name and renamed when whole, so a task that runs again replaces
    it by the same bytes; another split of the same rows gives the same shards. ``first_doc_id`` owns the first token; the last
    sequence is filled up with end tokens, ``filled`` counts the others. Null and empty texts are their end token; rows without doc_id
    or that repeat one are written like others; an empty table gives no shard. Other columns are ignored.
    """
    spark = docs.sparkSession
    where = _local(folder or intermediate(spark, "shards"))
    places = _local(intermediate(spark, "places"))
    for made in (where, places):
        os.makedirs(made, exist_ok=True)
    stored = durable(chunks(docs, path, doc_id, text), "tokens")
    tokens = offsets(stored, places)
    n, width = -(-tokens // stride), max(1, shard // (stride * 2))
    kind = stored.schema["docs"].dataType.elementType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, now = zstandard.ZstdDecompressor(), None
        cells, filled, owners = np.empty((0, stride), "<u2"), np.empty(0, np.int64), []

        def written() -> pa.RecordBatch:
            temporary = os.path.join(where, f".{shard_name(now)}.{uuid.uuid4().hex}")
            cells.tofile(temporary)
            os.replace(temporary, os.path.join(where, shard_name(now)))
            place = np.arange(len(cells))
            return batch(
                slot=now * width + place,
                byte=place * stride * 2,
                shard=np.full(len(cells), now, np.int32),
                first_doc_id=pa.array(owners, owner_kind),
                filled=filled,
                crc32=np.array([zlib.crc32(x) for x in cells], np.int64),
            )

        for b in batches:
            owner_kind = b.schema.field("owner").type.value_type
            for row, one in enumerate(b.column("shard").to_pylist()):
                if one != now:
                    if now is not None:
                        yield written()
                    now, count = one, min(width, n - one * width)
                    cells = np.full((count, stride), END, "<u2")
                    filled, owners = np.zeros(count, np.int64), [None] * count
                raw = np.frombuffer(unpack.decompress(b.column("ids")[row].as_py()), "<u2")
                slot, at, length = [b.column(c)[row].values.to_numpy() for c in ("slot", "at", "length")]
                slot = slot - now * width
                np.add.at(filled, slot, length)
                ends = np.cumsum(length)
                for s, a, m, e in zip(slot.tolist(), at.tolist(), length.tolist(), ends.tolist()):
                    cells[s, a : a + m] = raw[e - m : e]
                for nth in np.flatnonzero(at == 0).tolist():
                    owners[slot[nth]] = b.column("owner")[row].values[nth].as_py()
        if now is not None:
            yield written()

    rows = dealt(stored, places, n, width, stride, key)
    rows = rows.repartitionById(max(1, -(-n // width)), F.col("shard")).sortWithinPartitions("shard")
    schema = f"slot long, byte long, shard int, first_doc_id {kind}, filled long, crc32 long"
    done = durable(rows.mapInArrow(write, schema), "sequences")
    with open(os.path.join(where, "order.json"), "w") as out:
        json.dump({"stride": stride, "key": key, "bytes_per_id": 2, "sequences": n, "per_shard": width}, out)
    return done


def read_slots(folder: str, first: int, count: int) -> np.ndarray:
    """``count`` sequences from slot ``first`` on (fewer at the end), memory-mapped shard by shard."""
    where = _local(folder)
    with open(os.path.join(where, "order.json")) as f:
        order = json.load(f)
    last, width = min(order["sequences"], first + count), order["per_shard"]
    parts = [np.empty((0, order["stride"]), "<u2")]
    while first < last:
        data = np.memmap(os.path.join(where, shard_name(first // width)), "<u2", "r").reshape(-1, order["stride"])
        at = first % width
        parts.append(data[at : at + last - first])
        first += len(parts[-1])
    return np.concatenate(parts)
