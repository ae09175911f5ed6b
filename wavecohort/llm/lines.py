"""Fuzzy line deduplication by MinHash over character shingles.

Every line that is not blank has a signature of ``BANDS * ROWS`` minima over its shingles of
``SHINGLE`` characters. Lines that agree in a band are candidates. Lines of a band are compared by
a second signature in one go; where that agrees in at least ``AGREE`` of ``SKETCH`` places, all
shingles of both are compared, unless the two are connected already. Lines at least ``SIMILAR`` alike are linked, and of each connected
component one occurrence is kept, the one with the smallest doc_id and line number.

Texts are read once for the places and band keys of all lines. Keys are dealt as packed numbers, and only those
of two different lines become rows. Lines are known by a 64-bit hash until two different ones have to be compared,
and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from wavecohort.llm.blocks import SPACE, batch, mixed, powers, prefix, signed
from wavecohort.llm.graph import components
from wavecohort.session import discard, durable

SIMILAR = 0.8
SHINGLE = 8
#: At likeness 0.8 a pair shares a band with probability 0.997, at 0.85 with 0.9995.
BANDS, ROWS = 8, 3
#: Of places with likeness 0.8 at least so many agree with probability 0.9995; of places with 0.4, 0.003.
SKETCH, AGREE = 48, 29
#: Lines of a band that are held at once; a fuller band is split.
HELD = 256
#: Characters worked on at once; so many stay in a processor's cache.
BLOCK = 1 << 18
#: Lines, or band keys, of a task that are sent on at once.
SENT_LINES, SENT_KEYS = 1 << 16, 1 << 20
NO_ID = -(1 << 63)
BLANKS = " \t\n\x0b\f\r"

_DRAW = np.random.Generator(np.random.PCG64(8))
FACTORS = _DRAW.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _DRAW.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
MORE_FACTORS = _DRAW.integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
MORE_OFFSETS = _DRAW.integers(0, 1 << 32, SKETCH, dtype=np.uint32)
_LETTERS = mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def _texts(texts: Iterable[str], most: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """Row of the first text and some texts, at most ``most`` characters unless one is longer."""
    first, some, size = 0, [], 0
    for row, text in enumerate(texts):
        if some and size + len(text) > most:
            yield first, some
            first, some, size = row, [], 0
        some.append(text)
        size += len(text)
    if some:
        yield first, some


class Lines:
    """The lines of some texts that are not blank, without white space at their ends."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.points = points
        ends = np.flatnonzero(points == 10)
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = np.cumsum([t.count("\n") + 1 for t in texts])
        number = np.arange(len(ends)) - np.repeat(np.concatenate(([0], last[:-1])), np.diff(last, prepend=0))
        text = np.repeat(np.arange(len(texts)), np.diff(last, prepend=0))
        ink = np.flatnonzero(~((points < 256) & SPACE[np.minimum(points, 255)]))
        low, high = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
        full = high > low
        self.start, self.end = ink[low[full]], ink[high[full] - 1] + 1
        self.number, self.text = number[full], text[full]

    def ids(self) -> np.ndarray:
        raw = self.points.tobytes()
        digest = xxhash.xxh3_64_intdigest
        return np.array([digest(raw[s:e]) for s, e in zip((self.start * 4).tolist(), (self.end * 4).tolist())], np.uint64)

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the shingles that start at each character, and bounds for each line; a shorter line is one shingle."""
        points = self.points
        plain = not len(points) or points.max() < len(_LETTERS)
        sums = prefix(_LETTERS[points] if plain else mixed(points.astype(np.uint64) + np.uint64(1)))
        inverse = powers(len(sums))[1]
        found = np.zeros(len(self.points), np.uint64)
        n = len(self.points) - SHINGLE + 1
        if n > 0:
            found[:n] = mixed((sums[SHINGLE:] - sums[:n]) * inverse[:n])
        size = self.end - self.start
        short = size < SHINGLE
        s, e = self.start[short], self.end[short]
        found[s] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        return found, self.start, self.start + np.maximum(1, size - SHINGLE + 1)

    def sets(self) -> list[np.ndarray]:
        """The distinct shingles of each line, sorted."""
        found, s, e = self.shingles()
        for a, b in zip(s.tolist(), e.tolist()):
            found[a:b].sort()
        step = np.zeros(len(found) + 1, np.int8)
        step[s], step[e] = 1, -1
        new = np.cumsum(step[:-1], dtype=np.int8) > 0
        new[1:] &= found[1:] != found[:-1]
        new[s] = True
        upto = np.cumsum(new)
        return np.split(found[new], upto[e - 1])[:-1]

    def minima(self, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Smallest value of each hash function over each line's shingles, functions x lines."""
        found, s, e = self.shingles()
        values = np.append((found >> np.uint64(32)).astype(np.uint32), np.uint32(0))
        cut = np.stack((s, e), axis=1).ravel()
        least, hashed = np.empty((len(factors), len(s)), np.uint32), np.empty_like(values)
        for k in range(len(factors)):
            np.multiply(values, factors[k], out=hashed)
            np.add(hashed, offsets[k], out=hashed)
            least[k] = np.minimum.reduceat(hashed, cut)[::2]
        return least

    def sketches(self) -> np.ndarray:
        """Second signatures, 16 bits of each minimum, lines x places."""
        return (mixed(self.minima(MORE_FACTORS, MORE_OFFSETS).T.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)

    def bands(self) -> np.ndarray:
        """Band keys, lines x bands."""
        least = self.minima(FACTORS, OFFSETS).astype(np.uint64)
        keys = np.empty((least.shape[1], BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(keys), band + 1, np.uint64)
            for k in range(band * ROWS, band * ROWS + ROWS):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[k])
            keys[:, band] = key
        return keys

    def string(self, line: int) -> str:
        return self.points[self.start[line] : self.end[line]].tobytes().decode("utf-32-le", "surrogatepass")


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of shingles are alike; sizes that rule it out are not merged."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= SIMILAR * (len(a) + len(b) - common)


def _binary(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of some rows, cut after each of these numbers of rows."""
    offsets = np.concatenate(([0], ends)).astype(np.int64) * (rows.itemsize * rows.shape[1])
    data = pa.py_buffer(np.ascontiguousarray(rows))
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), data]).cast(pa.binary())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line with its place; the first of equal ones that are sent at once has its band keys, others have none."""

    def sent(ids: list, keys: list, doc: list, version: list, line: list) -> pa.RecordBatch:
        ids = np.concatenate(ids)
        first = np.zeros(len(ids), np.int64)
        first[np.unique(ids, return_index=True)[1]] = 1
        keys = _binary(np.concatenate(keys)[first > 0], np.cumsum(first))
        return batch(id=signed(ids), doc=np.concatenate(doc), version=np.concatenate(version), line=np.concatenate(line), keys=keys)

    for b in batches:
        doc, version = b.column("doc").to_numpy(), b.column("version").to_numpy()
        held: list[tuple[np.ndarray, ...]] = []
        for first, texts in _texts(b.column("text").fill_null("").to_pylist()):
            lines = Lines(texts)
            at = first + lines.text
            held.append((lines.ids(), lines.bands(), doc[at], version[at], lines.number))
            if sum(len(x[0]) for x in held) >= SENT_LINES:
                yield sent(*zip(*held))
                held = []
        if held:
            yield sent(*zip(*held))


def _dealer(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deals band keys and their lines over parts by the key, as packed pairs of numbers."""

    def sent(keys: list, ids: list) -> pa.RecordBatch:
        pairs = np.stack((np.concatenate(keys), np.concatenate(ids)), axis=1)
        part = (pairs[:, 0] % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=parts))
        some = np.flatnonzero(np.diff(ends, prepend=0))
        return batch(part=some.astype(np.int32), packed=_binary(pairs[order], ends[some]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.uint64)
            held.append((keys, np.repeat(b.column("id").to_numpy().view(np.uint64), BANDS)))
            if sum(len(k) for k, _ in held) >= SENT_KEYS:
                yield sent(*zip(*held))
                held = []
        if held:
            yield sent(*zip(*held))

    return deal


def _met(part: pa.Table) -> pa.Table:
    """The keys of a part that different lines share, with each of these lines."""

    def often(key: np.ndarray) -> np.ndarray:
        same = key[1:] == key[:-1]
        return (np.append(same, False) | np.insert(same, 0, False))[: len(key)]

    pairs = np.frombuffer(b"".join(part.column("packed").to_pylist()), np.uint64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0])]
    pairs = pairs[often(pairs[:, 0])]
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))[: len(pairs)]]
    pairs = pairs[often(pairs[:, 0])]
    return pa.table({"key": signed(pairs[:, 0].copy()), "id": signed(pairs[:, 1].copy())})


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked lines of each packed text, without white space at their ends, and their second signatures."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        ids, strings = [], []
        for packed, asked in zip(b.column("packed"), b.column("asked").to_pylist()):
            all_lines = unpack.decompress(packed.as_py()).decode().split("\n")
            for ask in asked:
                ids.append(ask["id"])
                strings.append(all_lines[ask["line"]].strip(BLANKS))
        for i, some in _texts(strings):
            sketches = _binary(Lines(some).sketches(), np.arange(1, len(some) + 1))
            yield batch(id=pa.array(ids[i : i + len(some)], pa.int64()), string=pa.array(some, pa.string()), sketch=sketches)


class Band:
    """The held lines of one part of a band, and which of the lines met so far are connected.

    ``group`` numbers the connected groups of the held lines; a line that only passes joins all groups
    it is like.
    """

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.sketches = np.empty((0, SKETCH), np.uint16)
        self.group = np.empty(0, np.int64)

    def hold(self, ids: list[int], sets: list[np.ndarray], sketches: np.ndarray) -> list[tuple[int, int]]:
        """Take these lines; links of each with those held before it."""
        first = len(self.ids)
        self.ids += ids
        self.sets += sets
        self.sketches = np.concatenate((self.sketches, sketches)) if first else sketches
        self.group = np.concatenate((self.group, np.arange(first, len(self.ids))))
        return self.links(ids, sets, sketches, first)

    def links(self, ids: list[int], sets: list[np.ndarray], sketches: np.ndarray, first: int | None = None) -> list[tuple[int, int]]:
        """Links of these lines with held ones that connect what was not connected.

        Lines that are held themselves begin at place ``first``; each of two held lines is compared with the other once.
        """
        found: list[tuple[int, int]] = []
        for i in range(0, len(ids), HELD):
            agree = (self.sketches[:, None, :] == sketches[None, i : i + HELD, :]).sum(axis=2)
            close = agree >= AGREE
            for v in range(close.shape[1]):
                if first is None:
                    near, group = np.flatnonzero(close[:, v]), None
                else:
                    near, group = np.flatnonzero(close[: first + i + v, v]), self.group[first + i + v]
                    near = near[self.group[near] != group]
                if not len(near):
                    continue
                near, own = near[np.argsort(-agree[near, v], kind="stable")], sets[i + v]
                while len(near):
                    h, near = int(near[0]), near[1:]
                    if _alike(own, self.sets[h]):
                        found.append((self.ids[h], ids[i + v]))
                        if group is None:
                            group = self.group[h]
                        else:
                            self.group[self.group == self.group[h]] = group
                        near = near[self.group[near] != group]
        return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, part, held first) to links."""
    at, band = None, Band()
    for b in batches:
        key, part = b.column("key").to_numpy(), b.column("part").to_numpy()
        held = b.column("held").to_numpy(zero_copy_only=False)
        ids = b.column("id").to_pylist()
        sketches = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
        found: list[tuple[int, int]] = []
        for first, strings in _texts(b.column("string").to_pylist()):
            own = Lines(strings).sets()
            k, p = key[first : first + len(own)], part[first : first + len(own)]
            cut = np.flatnonzero((k[1:] != k[:-1]) | (p[1:] != p[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(own)]):
                if at != (k[s], p[s]):
                    at, band = (k[s], p[s]), Band()
                n = s + int(held[first + s : first + e].sum())
                if n > s:
                    found += band.hold(ids[first + s : first + n], own[s:n], sketches[first + s : first + n])
                if e > n:
                    found += band.links(ids[first + n : first + e], own[n:e], sketches[first + n : first + e])
        if found:
            a, c = zip(*found)
            yield batch(a=pa.array(a, pa.int64()), b=pa.array(c, pa.int64()))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        texts = [pack.compress(t.encode()) if t is not None else None for t in b.column("text").to_pylist()]
        keys = {n: b.column(n) for n in b.schema.names if n != "text"}
        yield batch(**keys, packed=pa.array(texts, pa.binary()))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the marked lines out; further rows equal in id and text lose all lines that are not blank."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        texts, counts, removed = [], [], []
        for packed, gone, copy in zip(b.column("packed"), b.column("gone").to_pylist(), b.column("copy").to_pylist()):
            raw = packed.as_py()
            lines = unpack.decompress(raw).decode().split("\n") if raw is not None else []
            ink = [n for n, x in enumerate(lines) if x.strip(BLANKS)]
            drop = set(ink if copy else gone or ())
            texts.append("\n".join([x for n, x in enumerate(lines) if n not in drop]) if raw is not None else None)
            counts.append(len(ink))
            removed.append(len(drop))
        yield batch(
            rest=b.column("rest"),
            text=pa.array(texts, pa.string()),
            n_lines=np.array(counts, np.int64),
            n_removed=np.array(removed, np.int64),
        )


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines``, ``n_removed``: lines with ink, and those gone.

    Blank lines stay. White space at a line's ends doesn't count. Null texts stay null; a text
    whose lines all go is empty and its row stays; rows without doc_id come first. Rows that repeat a doc_id are
    ordered by a hash of their text; of rows equal in both, one has the lines. An empty table gives an
    empty one. All columns pass through (``n_lines`` and ``n_removed`` are replaced).
    """
    docs = docs.drop("n_lines", "n_removed")
    keyed = docs.select(
        _key(doc_id).alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text")
    )
    read = durable(keyed.mapInArrow(_read, "id long, doc long, version long, line long, keys binary"), "read")
    occurrences = durable(read.drop("keys"), "occurrences")
    shares = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = read.where(F.length("keys") > 0).select("id", "keys").mapInArrow(_dealer(shares), "part int, packed binary")
    members = durable(dealt.groupBy("part").applyInArrow(_met, "key long, id long"), "bands")
    discard(read)
    # Near copies share several bands; bands of the very same lines give the same links and are compared once.
    lines = F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), *lines).where("n > 1")
    buckets = durable(buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    members = durable(members.join(buckets, "key"), "candidates")

    place = F.struct("doc", "version", "line")
    firsts = durable(occurrences.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n")), "lines")

    suspects = members.select("id").distinct().join(firsts, "id")
    asked = suspects.groupBy("first.doc", "first.version").agg(
        F.collect_list(F.struct("id", F.col("first.line").alias("line"))).alias("asked")
    )
    small = keyed.mapInArrow(_pack, "doc long, version long, packed binary")
    strings = small.join(asked, ["doc", "version"]).where("packed is not null").select("packed", "asked")
    strings = strings.mapInArrow(_strings, "id long, string string, sketch binary")
    strings = durable(strings.dropDuplicates(["id"]), "strings")

    parts = F.ceil(F.col("n") / HELD).cast("int")
    own = F.pmod(F.hash("id"), parts).alias("own")
    # Each of two lines in different parts passes by the other once: the one of the later part.
    dealt = members.select("key", "id", own, F.explode(F.sequence(F.lit(0), own)).alias("part"))
    dealt = dealt.select("key", "part", (F.col("own") == F.col("part")).alias("held"), "id").join(strings, "id")
    ready = dealt.repartition("key", "part").sortWithinPartitions("key", "part", F.desc("held"))
    links = durable(ready.mapInArrow(_compare, "a long, b long"), "links")
    discard(strings)
    reach = components(links)

    group = firsts.join(reach.withColumnRenamed("node", "id"), "id", "left")
    single = group.where("component is null and n > 1").select("id", "first")
    several = group.where("component is not null")
    least = several.groupBy("component").agg(F.min("first").alias("kept"))
    several = several.select("id", "component").join(least, "component").select("id", F.col("kept").alias("first"))
    keep = durable(single.unionByName(several), "kept")
    gone = occurrences.join(keep, "id").where(place != F.col("first"))
    # Rows equal in id and text have the same lines; their numbers are told once for all.
    gone = gone.select("doc", "version", "line").distinct().groupBy("doc", "version").agg(F.collect_list("line").alias("gone"))

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest")
    rows = docs.select(_key(doc_id).alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"), rest)
    kind = rows.schema["rest"].dataType.simpleString()
    rows = rows.mapInArrow(_pack, f"doc long, version long, rest {kind}, packed binary")
    copy = F.row_number().over(Window.partitionBy("doc", "version").orderBy(F.lit(1))) - 1
    rows = rows.join(gone, ["doc", "version"], "left").withColumn("copy", copy)
    out = rows.mapInArrow(_rebuild, f"rest {kind}, text string, n_lines long, n_removed long")
    columns = [F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns, "n_lines", "n_removed")
