"""Alignment against both libraries on whole texts, byte by byte."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from wavecohort.llm import crosstok
from wavecohort.llm.queries import tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    return crosstok.Aligner(A, B)


def tokens(plain, text):
    """Ids of both with the bytes they end at, from the libraries; none where they don't spell the text."""
    if not text:
        return None
    a = plain.a.encode(" " + text, add_special_tokens=False).ids
    b = plain.b.encode(text)
    want = (" " + text).encode()
    if b"".join(plain.raw_a[i] for i in a) != want or b"".join(plain.raw_b[i] for i in b) != want:
        return None
    return [(i, e) for i, e in zip(a, np.cumsum([len(plain.raw_a[i]) for i in a]))], [(i, e) for i, e in zip(b, np.cumsum([len(plain.raw_b[i]) for i in b]))]


def links(found):
    a, b = found
    out, start = [], 0
    for i, end in a:
        before = 0
        for j, to in b:
            if max(start, before) < min(end, to):
                out.append((i, j))
            before = to
        start = end
    return out


def expected(plain, rows):
    held, each = Counter(), []
    for _, text in rows:
        found = tokens(plain, text)
        pairs = links(found) if found else []
        held.update(set(pairs))
        each.append((found, pairs))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for (key, _), (found, pairs) in zip(rows, each):
        if not found:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = found
        common = sorted({e for _, e in a} & {e for _, e in b})
        parts = ["|".join(",".join(str(i) for i, e in side if low < e <= high) for side in (a, b)) for low, high in zip([0, *common], common)]
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest()
        counts = [(held[p], held[p] == best[p[0]]) for p in pairs]
        out.append((key, len(a), len(b), len(parts), len(pairs), sum(t for _, t in counts), sum(n for n, _ in counts), digest))
    return sorted(out, key=str)


def run(docs, **options):
    return sorted(map(tuple, crosstok.aligned(docs, A, B, **options).collect()), key=str)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  a  b ", "a\n\nb  c\t d", "x y z  w", "1　 2   3", "  a  ",
    "<s> </s> <|endoftext|> <unk> <0x41>", "literal ▁ mark", "ends ▁", "Ünïcode 😀 wörds 漢字かな交じり文 text", "don't can't I'll we've they're",
    "aaaaaaaaaaaaaaaaaaaaaaa bbbbbbbbbbbbbb", "é combining", "\x00 nul \x1c sep \x85 nel", "12345678901234567890 3.14159", "http://example.net/a?b=c&d=e#f",
    "zero​width ﻿ bom", "x" * 500, "-" * 300, "tab\tseparated values\r\nand lines\r\n", "don 't", "à à à", "abĠc Ċ",
]


def test_odd_texts_like_the_libraries(make, plain):
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, "a"), (3, "a"), *[(7, t) for t in ODD]]
    assert run(make(rows)) == expected(plain, rows)


def test_prose_in_small_chunks_with_a_small_table(make, plain, odd):
    draw = np.random.default_rng(8)
    stems = ["the", "tion", "Über", "straße", "naïve", "ing", "un", "believ", "able", "42", "qu", "être", "señor", "x1"]
    word = lambda: "".join(stems[i] for i in draw.integers(0, len(stems), draw.integers(1, 4)))
    rows = [(i, " ".join(word() for _ in range(draw.integers(1, 60)))) for i in range(150)] + [(i, t) for i, t in odd if not t or len(t) < 5000]
    rows += [(900 + i, "the same text again") for i in range(120)]
    assert run(make(rows), chunk_bytes=700, words=40) == expected(plain, rows)


def test_a_very_long_text_and_one_without_spaces(make, plain):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    solid = "".join(chr(97 + (i * i) % 26) for i in range(60_000))
    got = {r[0]: r for r in run(make([(1, long), (2, solid), (3, "short")]))}
    for key, text in ((1, long), (2, solid)):
        a, b = tokens(plain, text)
        assert got[key][1:3] == (len(a), len(b))
        assert got[key][4] == len({e for _, e in a} | {e for _, e in b}) and got[key][6] >= got[key][4]


def test_empty_table(make):
    assert run(make([])) == []


def test_no_piece_goes_on_after_a_letter_and_a_space(plain):
    assert not [r for r in plain.raw_b if b" " in r.lstrip(b" ")] and not [r for r in plain.raw_a if b" " in r.lstrip(b" ") and not r.decode("utf-8", "ignore").isspace()]
    same = [(a, b) for a, b in enumerate(plain.identity.tolist()) if b >= 0]
    assert len(same) > 5000 and all(plain.raw_a[a] == plain.raw_b[b] for a, b in same)
