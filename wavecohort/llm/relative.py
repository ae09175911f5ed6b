"""Substring deduplication by winnowing with hashes of windows.

No relative Lempel-Ziv factors are built; the words removed are those of windows that start earlier.
Every window of ``WINDOW`` words has one *seed*, the ``SEED``-word gram with the smallest
hash in it (the leftmost of equal ones), so equal windows have equal seeds at equal places. Windows of
one seed stand next to each other; the words they cover together are its *stretch*. Only seeds that
occur again are looked at: a stretch that stands earlier as a whole is repeated in all its windows.
Where stretches of one seed differ, and only there, single windows are compared. The result is that of comparing all windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wavecohort.llm.blocks import SPACE, Block, batch, blocks, gram_hashes, prefix, ranges, signed
from wavecohort.session import durable, intermediate_table

WINDOW = 20
SEED = 5
NO_ID = -(1 << 63)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Stretches:
    """The seeds of a block's windows: ``seed`` (first word of the gram), windows ``first`` to ``last``, text ``of``."""

    def __init__(self, block: Block, window: int = WINDOW, seed: int = SEED):
        self.block, self.window = block, window
        n = len(block.starts)
        at = np.flatnonzero(block.of[: max(0, n - window + 1)] == block.of[window - 1 :])
        where, hashes = gram_hashes(block, seed)
        self.gram = np.zeros(n, np.uint64)
        self.gram[where] = hashes
        if not len(at):
            self.seed = self.first = self.last = self.of = np.empty(0, np.int64)
            return
        low = np.uint64((1 << 26) - 1)
        keys = (self.gram[: n - seed + 1] & ~low) | np.arange(n - seed + 1, dtype=np.uint64)
        chosen = (_least(keys, window - seed + 1)[at] & low).astype(np.int64)
        edge = np.flatnonzero((chosen[1:] != chosen[:-1]) | (block.of[at[1:]] != block.of[at[:-1]])) + 1
        self.first = at[np.concatenate(([0], edge))]
        self.last = at[np.concatenate((edge, [len(at)])) - 1]
        self.seed = chosen[np.concatenate(([0], edge))]
        self.of = block.of[self.first]

    def number(self, words: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Numbers of words within their texts."""
        return words - self.block.first_word[of]

    def rows(self, b: pa.RecordBatch, of: np.ndarray, *names: str) -> dict[str, np.ndarray]:
        return {n: b.column(n).to_numpy()[self.block.first + of] for n in names}


def _parts(b: pa.RecordBatch) -> Iterator[Stretches]:
    return (Stretches(x) for x in blocks(b.column("text")))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in _parts(b):
            yield batch(h=signed(s.gram[s.seed]), **s.rows(b, s.of, "row"), at=s.number(s.seed, s.of))


def _wanted(s: Stretches, b: pa.RecordBatch) -> np.ndarray:
    """The stretches of a block whose seed is among ``ats`` of their row."""
    lists = b.column("ats").slice(s.block.first, len(s.block))
    row = np.repeat(np.arange(len(s.block)), np.diff(np.asarray(lists.offsets)))
    at = lists.flatten().to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.isin(s.seed, at + s.block.first_word[row]))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in _parts(b):
            i = _wanted(s, b)
            yield batch(
                h=signed(s.gram[s.seed[i]]),
                c=signed(ranges(prefix(s.block.hashes), s.first[i], s.last[i] + s.window)),
                **s.rows(b, s.of[i], "doc", "copy", "row"),
                at=s.number(s.seed[i], s.of[i]),
                start=s.number(s.first[i], s.of[i]),
                n=s.last[i] - s.first[i] + 1,
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in _parts(b):
            i = _wanted(s, b)
            n = s.last[i] - s.first[i] + 1
            i = np.repeat(i, n)
            word = s.first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            yield batch(
                h=signed(s.gram[s.seed[i]]),
                w=signed(ranges(prefix(s.block.hashes), word, word + s.window)),
                **s.rows(b, s.of[i], "doc", "copy", "row"),
                start=s.number(word, s.of[i]),
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the marked words out of each text, and the white space after each of them."""
    for b in batches:
        for block in blocks(b.column("text")):
            lists = b.column("marks").slice(block.first, len(block))
            row = np.repeat(np.arange(len(block)), np.diff(np.asarray(lists.offsets)))
            flat = lists.flatten()
            at = flat.field("start").to_numpy(zero_copy_only=False)
            n = flat.field("n").to_numpy(zero_copy_only=False)
            start = at + block.first_word[row]
            depth = np.zeros(len(block.starts) + 1, np.int32)
            np.add.at(depth, start, 1)
            np.add.at(depth, start + n + WINDOW - 1, -1)
            gone = np.cumsum(depth[:-1]) > 0
            counts = np.diff(block.first_word)
            removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[block.first_word])
            texts = b.column("text").slice(block.first, len(block)).to_pylist()
            if gone.any():
                upto = np.concatenate((block.starts[1:], [len(block.data)]))
                upto = np.minimum(upto, block.offsets[block.of + 1] - 1)
                flips = np.zeros(len(block.data) + 1, np.int8)
                np.add.at(flips, block.starts[gone], 1)
                np.add.at(flips, upto[gone], -1)
                kept = np.cumsum(flips[:-1]) == 0
                kept[block.offsets[1:] - 1] = False  # the newline put after each text
                left = np.concatenate(([0], np.cumsum(kept)))[block.offsets]
                data = block.data[kept].tobytes()
                for t in np.flatnonzero(removed).tolist():
                    texts[t] = data[left[t] : left[t + 1]].decode()
            yield batch(
                rest=b.column("rest").slice(block.first, len(block)),
                text=pa.array(texts, pa.string()),
                n_words=counts,
                n_removed=removed,
            )


def _bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written once, dealt by ``key``, so that several joins on it don't move it again."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = intermediate_table(spark, name)
    writer = df.repartition(parts, key).write.bucketBy(parts, key).option("compression", "zstd")
    writer.saveAsTable(table)
    return spark.table(table)


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def _by_row(found: DataFrame, value: Column, name: str) -> DataFrame:
    return found.groupBy("row").agg(F.collect_list(value).alias(name))


def _copies(full: DataFrame) -> DataFrame:
    """``row, copy`` for the rows that share their ``doc``: ``copy`` is in the order of doc, text and row.

    Rows of one doc are dealt by ranges of their texts; only these texts move.
    """
    parts = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = durable(full.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "shared")
    rows = durable(full.select("doc", "row").join(shared, "doc").select("row"), "sharing")
    order = ["doc", "text", "row"]
    ranged = full.select(*order).join(rows, "row").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return durable(ranged.select("row", F.monotonically_increasing_id().alias("copy")), "copies")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated words of ``text``, and ``n_words``, ``n_removed``.

    A word is removed if a window of ``WINDOW`` words that covers it also starts earlier: at
    a smaller doc_id, or earlier in the same document. Texts that lose nothing stay as they
    are; others lose the words and the white space after each. Null texts stay null and have
    no words; an empty table gives an empty one. Rows without doc_id come first. Rows that repeat a
    doc_id are ordered by text and count as documents of their own. All columns pass through
    (``n_words`` and ``n_removed`` are replaced).
    """
    docs = docs.drop("n_words", "n_removed")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    keyed = docs.select(_key(doc_id).alias("doc"), F.col(text).alias("text"), rest.alias("rest"))
    full = _bucketed(keyed.withColumn("row", F.monotonically_increasing_id()), "row", "texts")
    copies = _copies(full)

    seeds = full.select("row", "text").mapInArrow(_seeds, "h long, row long, at long")
    # What a join looks up is written first: then a seed that very many documents share is
    # one of its rows and, on the other side, rows that the join can split.
    repeated = durable(seeds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "seeds")
    base = full.select("row", "doc", "text").join(copies, "row", "left")
    base = base.withColumn("copy", F.coalesce("copy", F.lit(0).cast("long")))
    found = _by_row(seeds.join(repeated, "h"), F.col("at"), "ats")
    place = "doc long, copy long, row long"
    parsed = base.join(found, "row").mapInArrow(_stretches, f"h long, c long, {place}, at long, start long, n long")
    parsed = durable(parsed, "stretches")

    place = F.struct("doc", "copy", "start", "at", "row")
    first = durable(parsed.groupBy("h", "c").agg(F.min(place).alias("first")), "factors")
    whole = parsed.join(first, ["h", "c"]).where(place != F.col("first")).select("row", "start", "n")

    several = durable(first.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "edges")
    edges = first.join(several, "h").select("first.row", "first.at")
    asked = base.join(_by_row(edges, F.col("at"), "ats"), "row")
    kind = "h long, w long, doc long, copy long, row long, start long"
    windows = durable(asked.mapInArrow(_windows, kind), "windows")
    place = F.struct("doc", "copy", "start", "row")
    earliest = windows.groupBy("h", "w").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    single = windows.join(durable(earliest.drop("n"), "earliest"), ["h", "w"]).where(place != F.col("first"))
    marks = whole.unionByName(single.select("row", "start", F.lit(1).cast("long").alias("n")))

    marked = full.select("row", "text", "rest").join(_by_row(marks, F.struct("start", "n"), "marks"), "row", "left")
    none = F.array().cast("array<struct<start:bigint,n:bigint>>")
    marked = marked.withColumn("marks", F.coalesce("marks", none)).drop("row")
    kind = full.schema["rest"].dataType.simpleString()
    out = marked.mapInArrow(_cut, f"rest {kind}, text string, n_words long, n_removed long")
    columns = [F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns, "n_words", "n_removed")


def words_digest(texts: DataFrame, text: str, digest: str) -> DataFrame:
    """Adds ``digest``: SHA-256 of the words of ``text`` joined by one space (null: of nothing)."""
    import hashlib

    kind = texts.select("*", F.lit("").alias(digest)).schema
    where = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for block in blocks(b.column(where)):
                data, starts, ends = block.spaced
                for s, e in zip(block.first_word[:-1].tolist(), block.first_word[1:].tolist()):
                    words = data[starts[s] : ends[e - 1]] if e > s else b""
                    out.append(hashlib.sha256(words).hexdigest())
            columns = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            yield batch(**columns, **{digest: pa.array(out, pa.string())})

    return texts.mapInArrow(run, kind)
