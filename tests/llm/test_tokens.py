"""Tokenizers against their libraries, packing and shards by exact round trips."""

import itertools
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from wavecohort.llm import packing, pieces, tokens  # noqa: E402
from wavecohort.llm.bytebpe import Encoder  # noqa: E402

BPE, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  ", "a", "  a  b ", "\n\n x\ty\n", "ﬁ Å Ａ", "😀😀 é́", "▁a▁ b", "<0x0A> <s> </s> <unk>", "x" * 300, "<|endoftext|> a",
    "it's  'tis \n  foo\n\nbar   z", "a\x1cb \x1c c", "1234 5678..., ---", "中文字符 漢字", "\ta b", "a \t b", "trail \n", " lead", "\x85 q",
    "The quick brown fox jumps over the lazy dog. " * 40,
]


def reference_ids(texts):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(BPE)
    known.encode_special_tokens = True
    return [x.ids for x in known.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("fast", [True, False])
def test_byte_bpe(fast):
    encoder = Encoder(BPE, fast=fast)
    assert (encoder.by_rank is not None) == fast
    for some in (TEXTS, TEXTS[::-1], TEXTS[5:9]):
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(some)] == reference_ids(some)


def test_every_code_point_has_the_ids_of_the_library():
    encoder = Encoder(BPE)
    points = [c for c in range(0x32000) if not 0xD800 <= c <= 0xDFFF] + list(range(0xE0000, 0xE0200))
    for i in range(0, len(points), 10_000):
        some = [f"a{c}b1{c}2!{c}! {c} {c}{c} \n{c}  a '{c}s" for c in map(chr, points[i : i + 10_000])]
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(some)] == reference_ids(some)


@pytest.mark.parametrize("text", ["x" * 200_000, " " * 2_000_000 + "a", "a" + "\n" * 300_000, "!" * 200_000, "漢字" * 50_000, " \t" * 40_000 + "x"])
def test_long_runs_have_the_ids_of_the_library(text):
    assert np.frombuffer(Encoder(BPE).encode([text])[0], "<u2").tolist() == reference_ids([text])[0]


def test_files_that_ranks_could_read_otherwise_are_left_to_the_library(tmp_path):
    import json

    with open(BPE, encoding="utf-8") as f:
        spec = json.load(f)
    merges = spec["model"]["merges"]
    merges[0], merges[9] = merges[9], merges[0]
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    assert Encoder(str(tmp_path / "other.json")).by_rank is None


@pytest.mark.parametrize("room", [3, 1000])
def test_sentencepiece(room):
    import sentencepiece

    library, mine = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Pieces(MODEL, words=room)
    for some in (TEXTS, TEXTS[::-1]):
        got = [np.frombuffer(x, "<u2").astype(int) for x in mine.encode(some)]
        assert [x.tolist() for x in got] == library.encode(some)
        assert [mine.decode(x) for x in got] == [library.decode(x.tolist()) for x in got]


def test_encode_and_decode_tables(make, odd):
    docs = make(odd + list(enumerate(TEXTS, 100)))
    rows = pieces.decoded(pieces.encoded(docs, MODEL), MODEL).collect()
    assert len(rows) == len(odd) + len(TEXTS)
    assert all(r.decoded == (r.text if r.text is None else r.text.replace("▁", " ")) for r in rows)
    assert all((r.piece_ids is None) == (r.text is None) and r.packed == "PACKED" for r in rows)
    assert pieces.encoded(make([]), MODEL).count() == 0


def greedy(lengths, capacity):
    """The method bin by bin, without counts."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        used, room = [], capacity
        for n in list(left):
            if n <= room:
                used.append(n)
                room -= n
                left.remove(n)
        if len(used) > 1:
            sums = [(a + b, max(a, b)) for a, b in itertools.combinations(left, 2) if a + b <= room + used[-1]]
            best = max(sums, default=(0, 0))[0]
            if best > used[-1]:
                left.append(used.pop())
                pair = next(p for p in itertools.combinations(left, 2) if sum(p) == best)
                for n in pair:
                    left.remove(n)
                left.sort(reverse=True)
        bins += 1
    return bins


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    draw = np.random.default_rng(seed)
    lengths = draw.integers(1, 60, 300)
    bins = packing.plan(np.bincount(lengths, minlength=65), 64)
    assert all(sum(used) <= 64 for used, _ in bins)
    packed = np.zeros(65, int)
    for used, times in bins:
        np.add.at(packed, used, times)
    assert (packed == np.bincount(lengths, minlength=65)).all()
    assert abs(sum(times for _, times in bins) - greedy(lengths.tolist(), 64)) <= 3
    assert packing.plan(np.zeros(5, int), 4) == [] and packing.plan(np.bincount([3] * 7), 6) == [([3, 3], 3), ([3], 1)]


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packed(make, odd, capacity):
    rows = odd + list(enumerate(TEXTS, 100))
    got = packing.packed(make(rows), BPE, capacity).collect()
    ids = [np.array([*x, packing.END], "<u4") for x in reference_ids([t or "" for _, t in rows])]
    wanted = []
    for (i, _), x in zip(rows, ids):
        at = 0
        for piece, n in enumerate(packing.cut_lengths(len(x), capacity)):
            wanted.append((str(i), piece, at, n, zlib.crc32(x[at : at + n].tobytes())))
            at += n
        assert at == len(x)
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == sorted(wanted)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [0, *ends[:-1]] == [o for o, _ in sorted(places)] and ends[-1] <= capacity
    assert packing.packed(make([]), BPE).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutation(n):
    got = tokens.slots(np.arange(n), n, key=5)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 100 or (got != tokens.slots(np.arange(n), n, key=6)).any()


def test_shards(make, odd, tmp_path):
    rows = odd + list(enumerate(TEXTS, 100))
    folder = str(tmp_path / "shards")
    got = tokens.materialise(make(rows), BPE, folder, stride=64, shard=20_000).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    data = tokens.read_slots(folder, 0, len(got) + 5)
    assert data.shape == (len(got), 64)
    assert all(zlib.crc32(data[r.slot].tobytes()) == r.crc32 for r in got) and len({r.shard for r in got}) > 5
    assert len({(r.shard, r.byte) for r in got}) == len(got) and all(r.byte % 128 == 0 for r in got)
    assert (tokens.read_slots(folder, 5, 9) == data[5:14]).all()
    # All tokens are there: each text with its end, and nothing else but the filling.
    wanted = sum(len(x) + 1 for x in reference_ids([t or "" for _, t in rows]))
    assert sum(r.filled for r in got) == wanted
    counts = np.bincount(data.ravel(), minlength=50257)
    for x in reference_ids([t or "" for _, t in rows]):
        np.subtract.at(counts, x, 1)
    assert counts[:50256].sum() == 0 and (counts[:50256] == 0).all()


@pytest.mark.parametrize("room", [500, 1 << 20])
def test_slots_do_not_depend_on_the_split(make, odd, tmp_path, monkeypatch, room):
    monkeypatch.setattr(tokens, "CHUNK", room)
    rows = odd + list(enumerate(TEXTS, 100))
    stream = [np.array([*x, tokens.END]) for _, x in sorted(zip([-1 if i is None else i for i, _ in rows], reference_ids([t or "" for _, t in rows])), key=lambda r: r[0])]
    owner = np.repeat(sorted(-1 if i is None else i for i, _ in rows), [len(x) for x in stream])
    stream = np.concatenate(stream)
    n = -(-len(stream) // 64)
    want = np.full((n, 64), tokens.END)
    for q, slot in enumerate(tokens.slots(np.arange(n), n).tolist()):
        some = stream[q * 64 : q * 64 + 64]
        want[slot, : len(some)] = some
    first = dict(zip(tokens.slots(np.arange(n), n).tolist(), owner[::64].tolist()))
    draw = np.random.default_rng(6)
    for parts in (2, 5, 9):
        folder = str(tmp_path / f"in{parts}")
        mixed = [rows[i] for i in draw.permutation(len(rows))] if parts > 2 else rows
        got = tokens.materialise(make(mixed).repartition(parts), BPE, folder, stride=64, shard=20_000).collect()
        assert (tokens.read_slots(folder, 0, n + 9) == want).all() and len(got) == n
        assert {r.slot: -1 if r.first_doc_id is None else r.first_doc_id for r in got} == first
        assert sum(r.filled for r in got) == len(stream) and sorted(r.filled for r in got)[1] == 64


def test_rows_equal_in_id_or_without_one_spread_and_stay_whole(make, tmp_path):
    rows = [(None, "the same text again")] * 300 + [(7, "the same text again")] * 300 + [(8, f"text {i}") for i in range(200)]
    for parts in (3, 8):
        folder = str(tmp_path / f"in{parts}")
        got = tokens.materialise(make(rows).repartition(parts), BPE, folder, stride=16, shard=512).collect()
        assert sum(r.filled for r in got) == sum(len(x) + 1 for x in reference_ids([t for _, t in rows]))
    assert (tokens.read_slots(str(tmp_path / "in3"), 0, 9999) == tokens.read_slots(str(tmp_path / "in8"), 0, 9999)).all()


def test_no_shards(make, tmp_path):
    assert tokens.materialise(make([]), BPE, str(tmp_path / "none")).count() == 0
    assert tokens.read_slots(str(tmp_path / "none"), 0, 5).shape == (0, 1024)


def test_pieces_of_many_documents_are_those_of_each():
    size = np.array([1, 7, 8, 9, 16, 17, 40, 1])
    row, piece, start, length = packing.cut_pieces(size, 8)
    got = [(r, p, s, n) for r, p, s, n in zip(row.tolist(), piece.tolist(), start.tolist(), length.tolist())]
    want = []
    for r, n in enumerate(size.tolist()):
        at = 0
        for p, m in enumerate(packing.cut_lengths(n, 8)):
            want.append((r, p, at, m))
            at += m
    assert got == want


def test_white_space_beside_spaces_after_words_are_known():
    encoder = Encoder(BPE)
    texts = ["a few plain words", "a  few plain\n words ", " few", "", "words \n plain", "\nfew words", "few  words a" + "x" * 70]
    want = reference_ids(texts)
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == want
