"""Arrow batches of texts as flat byte arrays: word bounds and rolling hashes without per-word Python.

Words are runs of bytes other than 0x20 and 0x09-0x0D. All hashes are 64-bit and the same
in every process: they come from one fixed random table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII capitals to small letters, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        grown = []
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            grown.append(np.multiply.accumulate(steps))
        _powers = tuple(grown)
    return _powers[0][:n], _powers[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums (one longer than ``values``) of which ``ranges`` takes hashes of any slice."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair of bounds."""
    inverse = powers(len(sums))[1]
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Block:
    """Some whole texts, each followed by one newline. ``first`` is the row of the first one."""

    first: int
    data: np.ndarray
    offsets: np.ndarray  # of texts in data, one more than texts

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        space = SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        return edge[0::2], edge[1::2]  # the last byte of a block is always a newline

    @property
    def starts(self) -> np.ndarray:
        return self._bounds[0]

    @property
    def ends(self) -> np.ndarray:
        return self._bounds[1]

    @cached_property
    def first_word(self) -> np.ndarray:
        """Number of the first word of each text, and the number of words."""
        return np.searchsorted(self.starts, self.offsets)

    @cached_property
    def of(self) -> np.ndarray:
        """The text (within the block) of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.first_word))

    @cached_property
    def hashes(self) -> np.ndarray:
        return ranges(prefix(_TABLE[self.data]), self.starts, self.ends)

    def lowered(self) -> Block:
        return Block(self.first, LOWER[self.data], self.offsets)

    @cached_property
    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words, each followed by one space, and the bounds of the words in that."""
        keep = ~SPACE[self.data]
        keep[self.ends] = True
        text = self.data[keep]
        after = np.cumsum(self.ends - self.starts + 1)
        starts = np.concatenate(([0], after[:-1])) if len(after) else after
        text[after - 1] = 32
        return text.tobytes(), starts, after - 1


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a column of texts into blocks; null texts count as empty."""
    if not len(column):
        return
    end, nothing = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
    texts = pc.binary_join_element_wise(column.cast(pa.large_string()).fill_null(""), end, nothing)
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(what, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def gram_hashes(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of every ``n`` consecutive words within one text."""
    count = len(block.starts) - n + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(block.of[:count] == block.of[n - 1 :])
    return at, ranges(prefix(block.hashes), at, at + n)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def batch(**columns) -> pa.RecordBatch:
    """A record batch of arrays by name."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))
