"""Alignment of two tokenizers' tokens over the same bytes, and how often their tokens meet.

Neither tokenizer joins letters over a single space between two words, so a text is cut there and each
distinct word is encoded and aligned once. A pair of ids of equal bytes (the identity map, made once for the
vocabulary) is counted in a vector as long as the vocabulary; only other pairs are shuffled, once for
each chunk of documents. What a chunk needs back are the counts of its own pairs: with them its words, and from its
words its documents, are scored. No table of pairs is sent whole to a task.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from wavecohort.llm.blocks import Block, blocks
from wavecohort.session import durable

CHUNK_BYTES = 1 << 21
#: Words a worker remembers; the table is emptied when full. Longer words are not joined with others to encode them.
WORDS, LONGEST, TOGETHER = 250_000, 64, 100
#: Words encoded, and texts read, in one go.
NEW, TEXTS = 10_000, 1000
RESULTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _blank_before(d: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Whether white space ends just before ``i``; outside the data counts as white space."""
    p1, p2, p3 = (d[np.maximum(i - k, 0)] for k in (1, 2, 3))
    return _blank(p3, p2, p1) | ((p1 >= 9) & (p1 <= 13)) | ((p1 >= 28) & (p1 <= 32)) | (i < 1)


def _blank_after(d: np.ndarray, i: np.ndarray) -> np.ndarray:
    last = len(d) - 1
    n1, n2, n3 = (d[np.minimum(i + k, last)] for k in (1, 2, 3))
    two = (n1 == 0xC2) & ((n2 == 0x85) | (n2 == 0xA0))
    return _blank(n1, n2, n3) | two | ((n1 >= 9) & (n1 <= 13)) | ((n1 >= 28) & (n1 <= 32)) | (i >= last)


def _blank(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Unicode white space of three bytes, or of the last two."""
    return (
        ((b == 0xC2) & ((c == 0x85) | (c == 0xA0)))
        | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
        | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
        | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    )


class Aligner:
    """Both vocabularies, and the alignment of every word met so far."""

    def __init__(self, path_a: str, path_b: str, words: int = WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on each core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size_a, size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        if max(size_a, size_b) > 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        letters = byte_letters()
        self.raw_a = [b""] * size_a
        for token, i in self.a.get_vocab().items():
            self.raw_a[i] = bytes([letters[c] for c in token]) if all(c in letters for c in token) else token.encode()
        self.raw_b, self.identity = [b""] * size_b, np.full(size_a, -1, np.int64)
        same: dict[bytes, int] = {}
        for i in range(size_b):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.raw_b[i] = bytes([int(piece[3:5], 16)])
            elif not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)):
                self.raw_b[i] = piece.replace("▁", " ").encode()
        for i, raw in enumerate(self.raw_b):  # a piece before the byte of the same value
            if raw and (raw not in same or self.b.is_byte(same[raw])):
                same[raw] = i
        for i, raw in enumerate(self.raw_a):
            self.identity[i] = same.get(raw, -1)
        self.len_a, self.len_b = (np.array([len(r) for r in raws], np.int64) for raws in (self.raw_a, self.raw_b))
        self.words = words
        self.forget()

    def forget(self) -> None:
        """Empty the table. Row 0 stands for words without tokens."""
        self.known: dict[bytes, int] = {}
        self.groups = [b""]
        self.counts = np.zeros((1, 4), np.int64)
        self.whole = np.zeros(1, bool)
        self.ends, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        ids_a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return list(zip(ids_a, self.b.encode(texts, num_threads=1)))

    def _exact(self, text: bytes, ids: tuple[list[int], list[int]]) -> bool:
        a, b = self.raw_a, self.raw_b
        return b"".join([a[i] for i in ids[0]]) == text and b"".join([b[i] for i in ids[1]]) == text

    def _learn(self, new: list[bytes]) -> None:
        easy, alone = [], []
        for w in new:
            t = w.decode("utf-8", "replace")
            (easy if w and len(w) <= LONGEST and len(t.split()) == 1 and not (t[0].isspace() or t[-1].isspace()) else alone).append((w, t))
        ready: list[tuple[list[bytes], tuple[list[int], list[int]]]] = []
        some = [easy[i : i + TOGETHER] for i in range(0, len(easy), TOGETHER)]
        for part, ids in zip(some, self._encoded([" ".join([t for _, t in part]) for part in some])):
            if self._exact(b" " + b" ".join([w for w, _ in part]), ids):
                ready.append(([w for w, _ in part], ids))
            else:
                alone += part
        for i in range(0, len(alone), TOGETHER):
            for (w, _), ids in zip(alone[i : i + TOGETHER], self._encoded([t for _, t in alone[i : i + TOGETHER]])):
                if w and self._exact(b" " + w, ids):
                    ready.append(([w], ids))
                else:
                    self.known[w] = 0
        if ready:
            self._align([w for ws, _ in ready for w in ws], *(np.array([i for _, ids in ready for i in ids[k]], np.int64) for k in (0, 1)))

    def _align(self, words: list[bytes], a: np.ndarray, b: np.ndarray) -> None:
        """Add words whose tokens stand one after the other in ``a`` and ``b``."""
        ends = np.cumsum([1 + len(w) for w in words])
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        cuts, common = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b)
        # Between two neighbouring ends lies the overlap of one token with one token.
        links = (a[np.searchsorted(ends_a, cuts)] << 16) | b[np.searchsorted(ends_b, cuts)]
        upto = [np.searchsorted(x, ends, side="right") for x in (ends_a, ends_b, common, cuts)]
        counts = np.stack([np.diff(u, prepend=0) for u in upto], 1)
        to_a, to_b = (np.searchsorted(x, common, side="right").tolist() for x in (ends_a, ends_b))
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        texts, i, j = [], 0, 0
        for x, y in zip(to_a, to_b):
            if x - i == 1 and y - j == 1:
                texts.append(f"{names_a[i]}|{names_b[j]}")
            else:
                texts.append(f"{','.join(names_a[i:x])}|{','.join(names_b[j:y])}")
            i, j = x, y
        row, at = len(self.groups), 0
        for w, to in zip(words, upto[2].tolist()):
            self.known[w] = row
            self.groups.append(";".join(texts[at:to]).encode())
            row, at = row + 1, to
        self.counts = np.concatenate([self.counts, counts])
        self.whole = np.concatenate([self.whole, np.ones(len(words), bool)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + upto[3]])
        self.links = np.concatenate([self.links, links])

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The table's row for each word."""
        new = {w for w in words if w not in self.known}
        if len(self.known) + len(new) > self.words:
            self.forget()
            new = set(words)
        learn = list(new)
        for i in range(0, len(learn), NEW):
            self._learn(learn[i : i + NEW])
        return np.array([self.known[w] for w in words], np.int64)


def _gathered(ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the items of ``rows`` in a flat list of rows, and how many each has."""
    first, size = ends[rows - 1], ends[rows] - ends[rows - 1]
    shift = np.repeat(first - (np.cumsum(size) - size), size)
    return np.arange(int(size.sum())) + shift, size


def _cut(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the words of a block, each with the one byte after it, and the text of each word."""
    d = block.data
    space = np.flatnonzero(d == 32)
    space = space[~(_blank_before(d, space) | _blank_after(d, space))]
    starts = np.sort(np.concatenate([block.offsets[:-1], space + 1]))
    return np.concatenate([starts, [len(d)]]), np.searchsorted(block.offsets, starts, side="right") - 1


class Chunk:
    """The tokens of one block of texts: results per text, and what is still needed to score them."""

    def __init__(self, block: Block, aligner: Aligner, totals: np.ndarray):
        n = len(block)
        bounds, of = _cut(block)
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(block.data))])
        coded = strings.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        rows = aligner.rows([w[:-1] for w in coded.dictionary.to_pylist()])
        del strings, coded
        whole = np.bincount(of[~aligner.whole[rows][codes]], minlength=n) == 0
        used = whole[of]
        of, codes = of[used], codes[used]
        self.numbers = np.stack([np.bincount(of, weights=aligner.counts[rows[codes], k], minlength=n) for k in range(4)]).astype(np.int64)
        first, each, groups = np.searchsorted(of, np.arange(n + 1)).tolist(), rows[codes].tolist(), aligner.groups
        self.digests = [hashlib.sha256(b";".join([groups[w] for w in each[i:j]])).hexdigest() if j > i else "" for i, j in zip(first, first[1:])]
        # Distinct words of each text, the words numbered within the chunk.
        found, times = np.unique((of << 32) | codes, return_counts=True)
        texts, words = found >> 32, found & 0xFFFFFFFF
        distinct, words = np.unique(words, return_inverse=True)
        at, size = _gathered(aligner.ends, rows[distinct])
        links = aligner.links[at]
        regular = aligner.identity[links >> 16] == (links & 0xFFFF)
        self.pairs, inner = np.unique(links[~regular], return_inverse=True)
        where = np.empty(len(links), np.int64)  # irregular pairs by their place in the chunk, others by -1 - id
        where[~regular], where[regular] = inner, -1 - (links[regular] >> 16)
        ends = np.concatenate([np.cumsum(size), [0]])
        at, each = _gathered(ends, words)
        held = np.unique((np.repeat(texts, each) << 32) | (where[at] + (1 << 31)))
        held = (held & 0xFFFFFFFF) - (1 << 31)
        self.documents = np.bincount(held[held >= 0], minlength=len(self.pairs))
        totals += np.bincount(-1 - held[held < 0], minlength=len(totals))
        parts = [np.bincount(texts, minlength=n), words, times, size, where]
        self.sizes = [len(p) for p in parts]
        raw = b"".join([p.astype("<i4").tobytes() for p in parts])
        self.bytes, self.packed = len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _scored(row: dict, alone: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best links and summed counts of each text of a chunk."""
    flat = np.frombuffer(pa.decompress(row["packed"], row["bytes"], codec="zstd", asbytes=True), "<i4").astype(np.int64)
    held, words, times, size, where = np.split(flat, np.cumsum(row["sizes"])[:-1])
    counts = np.zeros(len(row["pairs"]), np.int64)
    counts[row["at"]] = row["counts"]
    regular = where < 0
    number, token = np.empty(len(where), np.int64), np.empty(len(where), np.int64)
    token[regular], number[regular] = -1 - where[regular], alone[-1 - where[regular]]
    token[~regular], number[~regular] = row["pairs"][where[~regular]] >> 16, counts[where[~regular]]
    upto = np.concatenate([[0], np.cumsum(size)])
    text = np.repeat(np.arange(len(held)), held)
    out = []
    for values in (number == best[token], number):
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        each = (sums[upto[1:]] - sums[upto[:-1]])[words] * times
        total = np.zeros(len(held), np.int64)
        np.add.at(total, text, each)
        out.append(total)
    return out[0], out[1]


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id", chunk_bytes: int = CHUNK_BYTES, words: int = WORDS) -> DataFrame:
    """One row per document: ``key``, tokens, groups, links, best links, summed counts and the digest of the groups.

    A is a byte-level vocabulary read after a space, B a SentencePiece one that adds the space. Null and empty texts, and
    those whose pieces do not spell the text (a literal U+2581), have zeros and an empty digest and count
    for no pair. Rows that repeat a key, or have none, are documents of their own. Other columns are not carried. The
    driver sees two numbers per id of A's vocabulary. A chunk is some whole texts of ``chunk_bytes``, or one longer text.
    """
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    key_type = docs.schema["_key"].dataType
    fields = "chunk long, digests array<string>, packed binary, bytes long, sizes array<int>, pairs array<long>, documents array<long>"
    schema = T.StructType([T.StructField("keys", T.ArrayType(key_type)), *[T.StructField(n, T.ArrayType(T.LongType())) for n in RESULTS], *T.StructType.fromDDL(fields).fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(path_a, path_b, words), TaskContext.get().partitionId() << 33
        totals = np.zeros(len(aligner.raw_a), np.int64)
        kind = None
        some = (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS))
        for b in some:
            kind = b.column(0).type
            for block in blocks(b.column(1), chunk_bytes):
                c = Chunk(block, aligner, totals)
                keys = b.column(0).slice(block.first, len(block))
                yield row([keys, *c.numbers], number, c.digests, c.packed, c.bytes, c.sizes, c.pairs, c.documents)
                number += 1
        if kind is not None:
            seen = np.flatnonzero(totals)
            yield row([pa.array([], kind), *[[]] * 4], None, [], b"", 0, [], seen << 16 | aligner.identity[seen], totals[seen])

    def row(lists, number, digests, packed, size, sizes, pairs, documents) -> pa.RecordBatch:
        one = lambda v, kind=None: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v, kind))
        arrays = [one(lists[0]), *[one(v, pa.int64()) for v in lists[1:]], pa.array([number], pa.int64()), one(digests, pa.string()), pa.array([packed], pa.binary())]
        arrays += [pa.array([size], pa.int64()), one(sizes, pa.int32()), one(pairs, pa.int64()), one(documents, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    chunks = durable(docs.mapInArrow(read, schema), "chunks")
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "documents")).alias("at", "_p")).select("chunk", "at", "_p.pairs", "_p.documents")
    counts = durable(each.groupBy("pairs").agg(F.sum("documents").alias("n")), "pair_counts")
    vocabulary = Aligner(path_a, path_b)
    best, alone = (np.zeros(len(vocabulary.raw_a), np.int64) for _ in range(2))
    high = counts.groupBy(F.shiftright("pairs", 16).alias("a")).agg(F.max("n").alias("n")).toArrow()
    best[high.column("a").to_numpy()] = high.column("n").to_numpy()
    same = rows_of(docs.sparkSession, vocabulary.identity)
    found = counts.join(F.broadcast(same), "pairs", "left_semi").toArrow()  # as many rows as the vocabulary has ids
    alone[found.column("pairs").to_numpy() >> 16] = found.column("n").to_numpy()
    asked = each.where(F.col("chunk").isNotNull()).select("chunk", "at", "pairs").join(counts, "pairs")
    told = asked.groupBy("chunk").agg(F.collect_list(F.struct("at", "n")).alias("told"))
    full = chunks.where(F.col("chunk").isNotNull()).drop("documents").join(told, "chunk", "left")
    out = T.StructType([T.StructField(key, key_type), *[T.StructField(n, T.LongType()) for n in (*RESULTS, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cell = lambda name: b.column(b.schema.names.index(name))[i]
                flat = lambda name: cell(name).values
                told = flat("told")
                have = told is not None and len(told)
                row = {"packed": cell("packed").as_py(), "bytes": cell("bytes").as_py(), "sizes": flat("sizes").to_numpy(), "pairs": flat("pairs").to_numpy()}
                row |= {"at": told.field("at").to_numpy() if have else [], "counts": told.field("n").to_numpy() if have else []}
                n_best, count_sum = _scored(row, alone, best)
                arrays = [flat("keys"), *[flat(n) for n in RESULTS], pa.array(n_best), pa.array(count_sum), flat("digests")]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return full.mapInArrow(write, out)


def rows_of(spark, identity: np.ndarray) -> DataFrame:
    """The pairs of the identity map, one row per id of A that has one."""
    ids = np.flatnonzero(identity >= 0)
    return spark.createDataFrame(pa.table({"pairs": ids << 16 | identity[ids]}))
