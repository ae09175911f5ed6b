"""Token ids of a public byte-level BPE for many texts in one Python worker.

Where a file's merges are in the order of their ids, as in the public ones, merging by rank gives the
same ids as merging by rule, in about half the time; tests compare both on every code point. Other
files, and texts with a very long run of white space, go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from functools import cached_property, lru_cache

import numpy as np

#: How byte-level BPE cuts a text before it merges: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern walks back over a run of white space; one longer than this is left to ``tokenizers``.
LONG_BLANK = 100_000
_BLANK = re.compile(r"\s{%d}" % LONG_BLANK)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself where it shows, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids of all byte strings of a tokenizer's file, or none if merging by them could give other ids."""
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    usual = {"dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}
    if model["type"] != "BPE" or any(model.get(k) not in (v, "", None) for k, v in usual.items()) or spec["normalizer"]:
        return None
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    vocabulary, letters = model["vocab"], byte_alphabet()
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [vocabulary[m] for m in merged]
    special = {a["content"] for a in spec["added_tokens"]}
    if any(a >= b for a, b in zip(ids, ids[1:])) or set(vocabulary) - special != set(letters) | set(merged):
        return None
    if ids and max(vocabulary[x] for x in letters) > ids[0]:
        return None
    return {bytes(letters[c] for c in token): n for token, n in vocabulary.items() if token not in special}


class Encoder:
    """Texts to little-endian 16-bit ids; special strings are ordinary text."""

    def __init__(self, path: str, fast: bool = True):
        import tiktoken

        self.path, self.by_rank = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if max(spec["model"]["vocab"].values()) >= 1 << 16:
            raise ValueError("the vocabulary does not fit into 16 bits")
        if fast and (known := ranks(spec)):
            self.by_rank = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})

    @cached_property
    def tokenizer(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on each core already
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def _ids(self, text: str) -> list[int]:
        if self.by_rank is None or (len(text) >= LONG_BLANK and _BLANK.search(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.by_rank.encode_ordinary(text)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(self._ids(t), "<u2").tobytes() for t in texts]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder."""
    return Encoder(path)
