"""SentencePiece encoding and decoding by a Viterbi pass that words share.

A text is cut at its spaces into marked words. The distinct words a worker has not met are
sorted, which is the depth-first order of their trie, and read letter by letter: what was
found for a prefix is kept for all words that begin with it. The public model is a BPE model,
whose pieces come from merges, not from a sum of scores: of the ways to end a prefix with a piece, the
forward pass takes the one whose neighbour on the left stays apart from it under the merges (a
transition that scores 0, all others minus infinity). Exactly one does, so the ids are
those of the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Words and pairs of pieces a worker remembers; the tables are emptied when full.
WORDS = 1_000_000
LONGEST = 64
TEXTS = 1024


class Pieces:
    """The vocabulary of a SentencePiece BPE model with byte pieces."""

    def __init__(self, path: str, words: int = WORDS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.number: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            plain = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
            if plain:
                self.number[piece], self.rank[piece] = i, -model.get_score(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            self.raw.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.encode() if plain else b"")
        # Lengths of the pieces that end with two letters, the longest first.
        self.lengths: dict[str, list[int]] = {}
        for piece in sorted(self.number, key=len, reverse=True):
            found = self.lengths.setdefault(piece[-2:], [])
            if len(piece) > 1 and len(piece) not in found:
                found.append(len(piece))
        self.words = words
        self.known: dict[str, bytes] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: again and again the best pair is joined, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == np.inf:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays_apart(self, left: str, right: str) -> bool:
        found = self.apart.get((left, right))
        if found is None:
            if len(self.apart) >= self.words:
                self.apart.clear()
            found = self.apart[left, right] = self.merged(left + right) == [left, right]
        return found

    def is_whole(self, piece: str) -> bool:
        found = self.whole.get(piece)
        if found is None:
            found = self.whole[piece] = self.merged(piece) == [piece]
        return found

    def ids(self, parts: list[str]) -> bytes:
        out: list[int] = []
        for p in parts:
            if p in self.number:
                out.append(self.number[p])
            else:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return np.array(out, "<u2").tobytes()

    def learn(self, new: list[str]) -> None:
        """Encode new words in sorted order. ``last[i]`` is the piece that ends the first i letters of the word at hand."""
        last, before = [""], ""
        lengths, rank, none = self.lengths, self.rank, []
        for word in sorted(new):
            share, most = 0, min(len(before), len(word))
            while share < most and before[share] == word[share]:
                share += 1
            del last[share + 1 :]
            for end in range(share + 1, len(word) + 1):
                for length in lengths.get(word[max(0, end - 2) : end], none):
                    begin = end - length
                    piece = word[begin:end]
                    if begin < 0 or piece not in rank or not self.is_whole(piece):
                        continue
                    if not begin or self.stays_apart(last[begin], piece):
                        last.append(piece)
                        break
                else:
                    last.append(word[end - 1])  # no longer piece ends here
            parts, end = [], len(word)
            while end:
                parts.append(last[end])
                end -= len(last[end])
            self.known[word] = self.ids(parts[::-1])
            before = word

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 16-bit numbers."""
        cut: list[list[str]] = []
        for t in texts:
            if not t:
                cut.append([])
            elif "  " in t or MARK in t or t[0] == " " or t[-1] == " ":
                cut.append(re.findall(f"{MARK}+[^{MARK}]*", MARK + t.replace(" ", MARK)))
            else:
                cut.append([MARK + w for w in t.split(" ")])
        known = self.known
        new = {w for parts in cut for w in parts if w not in known}
        if len(known) + len(new) > self.words:
            known.clear()
            new = {w for parts in cut for w in parts}
        self.learn(list(new))
        get = known.__getitem__
        out = [b"".join(map(get, parts)) for parts in cut]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Bytes that are no UTF-8 become replacement characters."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def _lists(column: pa.Array, values: list) -> pa.Array:
    """16-bit ids per row as lists of integers; null where the column is null."""
    sizes = [len(v) // 2 for v in values]
    flat = np.frombuffer(b"".join(values), "<u2").astype(np.int32)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat), mask=column.is_null())


def _replaced(b: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [(n, b.column(i)) for i, n in enumerate(b.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + [values], names=[n for n, _ in kept] + [name])


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as a list of integers.

    Null texts have null, empty ones an empty list. Other columns pass through; one named
    like the new one is replaced. An empty table gives an empty one.
    """
    docs = docs.drop(ids)
    where = docs.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{ids}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                some = b.slice(i, TEXTS)
                column = some.column(where)
                yield _replaced(some, ids, _lists(column, pieces.encode(column.fill_null("").to_pylist())))

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids``: null for null, empty for none. Null ids in a list and control pieces say nothing."""
    rows = rows.drop(text)
    where = rows.columns.index(ids)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                some = b.slice(i, TEXTS)
                texts = [
                    pieces.decode(x.values.drop_null().to_numpy(zero_copy_only=False)) if x.is_valid else None
                    for x in some.column(where)
                ]
                yield _replaced(some, text, pa.array(texts, pa.string()))

    return rows.mapInArrow(run, schema)
