"""Interpolated modified Kneser-Ney bigram model, counted in Spark, memory-mapped for scoring.

1. Words are counted: a task sums the words it meets by hash and sends one sorted array for
   each shard of the hash range; a shard adds up what it gets. A word's number is its place
   in the sorted hashes of all shards.
2. Pairs (previous word, word) are counted in the same way. A pair's shard depends on the
   previous word; a frequent one is dealt over several shards by the next word, as many as its
   count asks for. Shards also give the numbers of different previous and next words.
3. Arrays lie as plain files in the shared folder; workers map them and look up
   the sorted distinct pairs of many texts at once.

A frequent word or pair is one entry of an array for each task, whatever its count.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import cached_property
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from wavecohort.llm.blocks import Block, batch, blocks, mixed
from wavecohort.session import durable, intermediate

BLOCK = 1 << 23
#: Tokens a task counts before it sends what it has.
HELD = 1 << 22
#: Bytes of training text for each shard of words, and of pairs.
WORD_SHARD = 256 << 20
PAIR_SHARD = 32 << 20
#: A previous word this frequent is dealt over several shards of pairs.
CROWDED = 1 << 20
END = np.uint64(0x5EED0E4D00000001)


class Tokens:
    """The lower-cased words of a block with one end after each text."""

    def __init__(self, block: Block):
        block = block.lowered()
        ends = block.first_word[1:] + np.arange(len(block))
        self.first = block.first_word[:-1] + np.arange(len(block))
        self.count = ends - self.first + 1
        self.hashes = np.empty(len(block.starts) + len(block), np.uint64)
        inner = np.ones(len(self.hashes), bool)
        inner[ends] = False
        self.hashes[ends] = END
        self.hashes[inner] = block.hashes


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def added(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else order
    return keys[first], *[np.add.reduceat(c[order], first) if len(first) else c for c in counts]


def _packed(x: np.ndarray) -> bytes:
    """Compressed bytes, all first bytes of the numbers first: sorted numbers differ in few of them."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _sent(shard: np.ndarray, shards: int, keys: np.ndarray, *counts: np.ndarray) -> pa.RecordBatch:
    """One row for each shard, of keys that are sorted within it."""
    cut = np.searchsorted(shard, np.arange(shards + 1))
    full = np.flatnonzero(np.diff(cut))
    rows = [(keys[cut[s] : cut[s + 1]], *[c[cut[s] : cut[s + 1]] for c in counts]) for s in full]
    columns = {"shard": full.astype(np.int64), "keys": [_packed(r[0]) for r in rows]}
    for n in range(len(counts)):
        columns[f"c{n}"] = [_packed(r[n + 1].astype(np.int64)) for r in rows]
    return batch(**{k: v if k == "shard" else pa.array(v, pa.binary()) for k, v in columns.items()})


def _gathered(table: pa.Table, kind: type) -> tuple[np.ndarray, ...]:
    """All rows of one shard added up."""
    keys = np.concatenate([_unpacked(x.as_py(), kind) for x in table.column("keys")])
    names = [n for n in table.column_names if n[0] == "c"]
    return added(keys, *[np.concatenate([_unpacked(x.as_py(), np.int64) for x in table.column(n)]) for n in names])


def _store(where: str, name: str, x: np.ndarray) -> None:
    """Write under another name, then rename: a task that runs again leaves whole files."""
    temporary = os.path.join(where, f".{name}-{uuid.uuid4().hex}")
    x.tofile(temporary)
    os.replace(temporary, os.path.join(where, name))


def _levels(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more; 0.5, 1 and 1.5 where they can't be estimated."""
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    raw = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(raw, 0.0, [0.0, 1.0, 2.0, 3.0])


class Words:
    """The word arrays of a folder. Number of a word: its place in all shards, one after the other."""

    def __init__(self, where: str, sizes: list[int], texts: int):
        self.where, self.sizes, self.texts = where, sizes, texts
        self.base = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("where", "sizes", "texts", "base")}

    @property
    def start(self) -> int:
        """The number that stands for the beginning of a text."""
        return int(self.base[-1])

    def _map(self, name: str, kind: type) -> list[np.ndarray]:
        return [
            np.memmap(os.path.join(self.where, f"{name}-{s}"), kind, "r") if n else np.empty(0, kind)
            for s, n in enumerate(self.sizes)
        ]

    @cached_property
    def hashes(self) -> list[np.ndarray]:
        return self._map("words", np.uint64)

    @cached_property
    def counts(self) -> list[np.ndarray]:
        return self._map("counts", np.int64)

    @cached_property
    def around(self) -> list[np.ndarray]:
        """Per word: next words met once, twice, more often, and different previous words."""
        return [x.reshape(-1, 4) for x in self._map("around", np.int64)]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes; -1 for words that were not counted."""
        out = np.full(len(hashes), -1, np.int64)
        cut = np.searchsorted(shard_of(hashes, len(self.sizes)), np.arange(len(self.sizes) + 1))
        for s in np.flatnonzero(np.diff(cut)):
            own, known = hashes[cut[s] : cut[s + 1]], self.hashes[s]
            if len(known):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                out[cut[s] : cut[s + 1]] = np.where(known[at] == own, at + self.base[s], -1)
        return out

    def take(self, arrays: list[np.ndarray], numbers: np.ndarray) -> np.ndarray:
        """Rows of the arrays at sorted numbers."""
        cut = np.searchsorted(numbers, self.base)
        return np.concatenate([arrays[s][numbers[cut[s] : cut[s + 1]] - self.base[s]] for s in range(len(self.sizes))])

    def context_counts(self, numbers: np.ndarray) -> np.ndarray:
        """How often each of the sorted numbers comes before a word; the start before one for each text."""
        inner = numbers < self.start
        return np.concatenate((self.take(self.counts, numbers[inner]), np.full((~inner).sum(), self.texts)))


def pair_shard(previous: np.ndarray, word: np.ndarray, times: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each pair; ``times`` is the count of the previous word."""
    parts = (np.maximum(times, 1) - 1) // CROWDED + 1
    part = mixed(word.astype(np.uint64)) % parts.astype(np.uint64)
    return ((mixed(previous.astype(np.uint64)) + part) % np.uint64(shards)).astype(np.int64)


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            keys, n = added(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            return _sent(shard_of(keys, shards), shards, keys, n)

        for b in batches:
            for block in blocks(b.column(0), BLOCK):
                held.append(np.unique(Tokens(block).hashes, return_counts=True))
                size += len(held[-1][0])
                if size >= HELD:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    return run


def _keep_words(where: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        words, counts = _gathered(table, np.uint64)
        _store(where, f"words-{shard}", words)
        _store(where, f"counts-{shard}", counts)
        return pa.table({"shard": [shard], "size": [len(words)], "tokens": [int(counts.sum())]})

    return run


def _pairs(tokens: Tokens, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the previous word and the word for every token."""
    distinct, where = np.unique(tokens.hashes, return_inverse=True)
    word = words.numbers(distinct)[where]
    previous = np.empty_like(word)
    previous[1:] = word[:-1]
    previous[tokens.first] = words.start
    return previous, word


def _count_pairs(words: Words, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            keys, n = added(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            previous, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            shard = pair_shard(previous, word, words.context_counts(previous), shards)
            order = np.argsort(shard, kind="stable")
            return _sent(shard[order], shards, keys[order], n[order])

        for b in batches:
            for block in blocks(b.column(0), BLOCK):
                previous, word = _pairs(Tokens(block), words)
                keys = (previous.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)
                held.append(np.unique(keys, return_counts=True))
                size += len(held[-1][0])
                if size >= HELD:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    return run


def _keep_pairs(words: Words):
    """Store the pairs of a shard; give, for each shard of words, what the pairs tell of their words."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = _gathered(table, np.uint64)
        _store(words.where, f"pairs-{shard}", keys)
        _store(words.where, f"pair-counts-{shard}", counts)
        previous, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inner = previous < words.start
        one, two, more = [((counts == 1) & inner), ((counts == 2) & inner), ((counts > 2) & inner)]
        none = np.zeros(len(word), bool)
        ids = np.concatenate((previous[inner], word))
        sums = [np.concatenate((x[inner], none)).astype(np.int64) for x in (one, two, more)]
        sums.append(np.concatenate((none[inner], ~none)).astype(np.int64))
        ids, *sums = added(ids, *sums)
        to = np.searchsorted(words.base, ids, side="right") - 1
        out = _sent(to, len(words.sizes), (ids - words.base[to]).astype(np.uint32), *sums)
        edge = counts[~inner]
        facts = [*_levels(counts), int((edge == 1).sum()), int((edge == 2).sum()), int((edge > 2).sum()), len(keys)]
        rows = pa.Table.from_batches([out])
        rows = rows.append_column("pair_shard", pa.array([shard] * len(rows), pa.int64()))
        return rows.append_column("facts", pa.array([facts] * len(rows), pa.list_(pa.int64())))

    return run


def _keep_around(words: Words):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        ids, *sums = _gathered(table, np.uint32)
        around = np.zeros((words.sizes[shard], 4), np.int64)
        around[ids] = np.stack(sums, axis=1)
        _store(words.where, f"around-{shard}", around)
        previous = around[:, 3]
        facts = [*_levels(previous), int((previous > 2).sum()), int(previous.sum())]
        return pa.table({"shard": [shard], "facts": pa.array([facts], pa.list_(pa.int64()))})

    return run


class Model:
    """A counted model: ``words``, sizes of the pair shards, and the sums the formula needs."""

    def __init__(self, words: Words, tokens: int, pair_sizes: list[int], pairs: list[int], unigrams: list[int]):
        self.words, self.tokens, self.pair_sizes = words, tokens, pair_sizes
        self.cut = discounts(*pairs[:4])
        self.start_gamma = float(self.cut[1:] @ pairs[4:7]) / max(1, words.texts)
        self.low_cut = discounts(*unigrams[:4])
        self.total = max(1, unigrams[5])
        self.low_gamma = float(self.low_cut[1:] @ [unigrams[0], unigrams[1], unigrams[4]]) / self.total

    def _pair(self, name: str, kind: type) -> list[np.ndarray]:
        where = self.words.where
        return [np.memmap(os.path.join(where, f"{name}-{s}"), kind, "r") if n else None for s, n in enumerate(self.pair_sizes)]

    @cached_property
    def pair_keys(self) -> list[np.ndarray]:
        return self._pair("pairs", np.uint64)

    @cached_property
    def pair_counts(self) -> list[np.ndarray]:
        return self._pair("pair-counts", np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("pair_") or k == "pair_sizes"}

    def _counted(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs."""
        out = np.zeros(len(keys), np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(len(self.pair_sizes) + 1))
        for s in np.flatnonzero(np.diff(cut)):
            if self.pair_sizes[s]:
                own = order[cut[s] : cut[s + 1]]
                known = self.pair_keys[s]
                at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                out[own] = np.where(known[at] == keys[own], self.pair_counts[s][at], 0)
        return out

    def scores(self, tokens: Tokens) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, the base score and the model's log10 probability."""
        words, vocabulary = self.words, self.words.start
        previous, word = _pairs(tokens, words)
        distinct, back = np.unique(word, return_inverse=True)
        known = distinct >= 0
        count = np.zeros(len(distinct), np.int64)
        left = np.zeros(len(distinct), np.int64)  # different previous words
        count[known] = words.take(words.counts, distinct[known])
        left[known] = words.take(words.around, distinct[known])[:, 3]
        low = np.maximum(left - self.low_cut[np.minimum(left, 3)], 0) / self.total
        low += self.low_gamma / (vocabulary + 1)
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (vocabulary + 1)))

        before, at = np.unique(previous, return_inverse=True)
        inner = (before >= 0) & (before < vocabulary)
        times = np.zeros(len(before), np.int64)
        times[before == vocabulary] = words.texts
        gamma = np.ones(len(before))
        gamma[before == vocabulary] = self.start_gamma
        times[inner] = words.take(words.counts, before[inner])
        gamma[inner] = words.take(words.around, before[inner])[:, :3] @ self.cut[1:] / np.maximum(times[inner], 1)

        p = gamma[at] * low[back]
        seen = np.flatnonzero((previous >= 0) & (word >= 0) & (times[at] > 0))
        keys = (previous[seen].astype(np.uint64) << np.uint64(32)) | word[seen].astype(np.uint64)
        pairs, first, which = np.unique(keys, return_index=True, return_inverse=True)
        first = seen[first]
        n = self._counted(pairs, pair_shard(previous[first], word[first], times[at[first]], len(self.pair_sizes)))
        high = np.maximum(n - self.cut[np.minimum(n, 3)], 0) / np.maximum(times[at[first]], 1)
        p[seen] += high[which]
        p = np.maximum(p, np.finfo(float).tiny)
        total = lambda x: np.add.reduceat(x, tokens.first)
        return {
            "n_tokens": tokens.count,
            "n_known": total((count > 0)[back].astype(np.int64)),
            "base_score": total(base[back]),
            "score": total(np.log10(p)),
        }


def _path(folder: str) -> str:
    at = urlparse(folder)
    if at.scheme not in ("", "file"):
        raise ValueError(f"the model is memory-mapped: mount {folder} and name it as a path")
    return at.path


def train(texts: DataFrame, text: str = "text", folder: str | None = None) -> Model:
    """Count the model of one column of texts into ``folder`` (by default a new one in the shared
    folder, which ``drop_intermediates`` removes).

    A null text is empty and counts one end. To the driver come a few numbers for each shard.
    """
    spark = texts.sparkSession
    where = _path(folder or intermediate(spark, "bigrams"))
    os.makedirs(where, exist_ok=True)
    texts = texts.select(F.col(text).alias("text"))
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    word_shards, pair_shards = (max(8, -(-int(size) // x)) for x in (WORD_SHARD, PAIR_SHARD))

    sent = texts.mapInArrow(_count_words(word_shards), "shard long, keys binary, c0 binary")
    kept = sent.groupBy("shard").applyInArrow(_keep_words(where), "shard long, size long, tokens long").collect()
    sizes = {r.shard: r.size for r in kept}
    words = Words(where, [sizes.get(s, 0) for s in range(word_shards)], n)
    if words.start >= (1 << 32) - 1:
        raise ValueError("more than 2**32 different words")

    sent = texts.mapInArrow(_count_pairs(words, pair_shards), "shard long, keys binary, c0 binary")
    columns = "shard long, keys binary, c0 binary, c1 binary, c2 binary, c3 binary"
    told = sent.groupBy("shard").applyInArrow(_keep_pairs(words), f"{columns}, pair_shard long, facts array<long>")
    told = durable(told, "around")
    facts = told.groupBy("pair_shard").agg(F.first("facts").alias("facts")).collect()
    pair_sizes = {r.pair_shard: r.facts[7] for r in facts}
    pairs = np.sum([r.facts for r in facts], axis=0).tolist() if facts else [0] * 8
    around = told.drop("pair_shard", "facts").groupBy("shard")
    levels = around.applyInArrow(_keep_around(words), "shard long, facts array<long>").collect()
    unigrams = np.sum([r.facts for r in levels], axis=0).tolist() if levels else [0] * 6
    tokens = sum(r.tokens for r in kept)
    return Model(words, tokens, [pair_sizes.get(s, 0) for s in range(pair_shards)], pairs, unigrams)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    ``score`` is the log10 probability of the words and the end, ``base_score`` that of single
    words with 0.1 added to each count. Null and empty texts are their end alone. Rows without
    doc_id or that repeat one have rows of their own. A model of no text gives every word the
    same probability. An empty table gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(1), BLOCK):
                found = model.scores(Tokens(block))
                yield batch(
                    doc_id=b.column(0).slice(block.first, len(block)),
                    n_tokens=found["n_tokens"],
                    n_known=found["n_known"],
                    train_tokens=np.full(len(block), model.tokens, np.int64),
                    base_score=found["base_score"],
                    score=found["score"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select(doc_id, text).mapInArrow(run, schema)
