"""Line, document and substring deduplication against brute force, and odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wavecohort.llm import anchors, lines, relative
from wavecohort.llm.anchors import FIELDS, LINK, Field
from wavecohort.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def keys(rows):
    """Row numbers in the order the operators give documents: no id first, then id, then text."""
    return sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, rows[n][1] is not None, (rows[n][1] or "").encode()))


def crowd():
    """Rows that share one id or have none, each with a text of its own and some repeated words."""
    same = " ".join(f"same{i}" for i in range(30))
    return [(i, f"{k % 7} {same} " + " ".join(f"r{k}x{j}" for j in range(25))) for k in range(60) for i in (None, 77)]


def corpus(seed=1, n=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    said = lambda k: [draw.choice(vocabulary) for _ in range(k)]
    passage = said(70)
    rows = []
    for i in range(n):
        words = said(draw.randint(0, 90))
        if i % 3 == 0:
            at = draw.randint(0, len(words))
            words[at:at] = passage[draw.randint(0, 20) : draw.randint(30, 70)]
        if i % 10 == 9:
            words = rows[-1][1].split()
            words[len(words) // 2 : len(words) // 2 + 1] = said(1)
        if i % 17 == 5:
            words += ["ha"] * 60
        rows.append((i, draw.choice([" ", "  ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("window", [20])
def test_repeated_windows_go(make, odd, window):
    rows = odd + corpus()
    seen, expected = set(), []
    for n in keys(rows):
        words = WORD.findall((rows[n][1] or "").encode())
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        expected.append((rows[n][0], len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    out = relative.deduplicated(make(rows))
    assert out.columns[:2] == ["doc_id", "text"] and {"doc", "copy", "rest"} <= set(out.columns)
    got = relative.words_digest(out, "text", "digest").select("doc_id", "n_words", "n_removed", "digest", "rest").collect()
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted([tuple(r)[:4] for r in got], key=order) == sorted(expected, key=order)
    assert {r.rest for r in got} == {"REST"}


def test_rows_of_one_id_are_ordered_by_text(make):
    test_repeated_windows_go(make, crowd() + [(76, crowd()[3][1])], 20)


def test_no_row_carries_what_others_of_its_id_have(make, monkeypatch):
    """What is looked up for a row is its own, however many rows share the id."""
    most, gathered = [], relative._by_row

    def watched(found, value, name):
        out = gathered(found, value, name)
        most.append(out.agg(F.max(F.size(name))).first()[0] or 0)
        return out

    monkeypatch.setattr(relative, "_by_row", watched)
    relative.deduplicated(make(crowd())).count()
    assert len(most) == 3 and 0 < max(most) < 60


def test_untouched_texts_stay_as_they_are(make):
    rows = [(1, "some  words\there\n"), (2, None), (3, "")]
    assert sorted(relative.deduplicated(make(rows)).select("doc_id", "text").collect()) == [tuple(r) for r in rows]


def print_of(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORD.findall(b)
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def test_fingerprints_and_components(make, odd):
    rows = odd + corpus(2)
    got = anchors.near_duplicates(make(rows)).collect()
    prints = [(i, print_of(t)) for i, t in rows]
    assert sorted((r.doc_id or -1, r.fp % 2**64) for r in got) == sorted((i or -1, f) for i, f in prints)
    label = list(range(len(prints)))
    for _ in prints:
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= LINK:
                    label[a] = label[b] = min(label[a], label[b])
    groups = {}
    for (i, f), c in zip(prints, label):
        if i is not None:
            groups[c] = min(groups.get(c, i), i)
    wanted = {f: groups.get(c) for (_, f), c in zip(prints, label)}
    assert all(r.component_id == wanted[r.fp % 2**64] for r in got)


@pytest.mark.parametrize("homes", [8, 1024])
def test_dense_and_split_anchors(sent, homes):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**64, 40, dtype=np.uint64)
    near = base[draw.integers(0, 3, 600)]
    for _ in range(4):
        near = near ^ (np.uint64(1) << draw.integers(0, 64, 600, dtype=np.uint64))
    prints = np.unique(np.concatenate((base, near, [np.uint64(0), np.uint64(2**64 - 1)])))
    table = sent.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    got = {r.node: r.component for r in components(anchors.fingerprint_links(table, homes=homes)).collect()}
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= LINK
    label = np.arange(len(prints))
    while True:
        lower = np.where(close, label[None, :], len(prints)).min(axis=1)
        if (lower == label).all():
            break
        label = lower
    mine = np.array([got.get(int(x), int(x)) for x in prints.view(np.int64)])
    assert all((mine[label == c] == mine[label == c][0]).all() for c in set(label)) and len(set(mine)) == len(set(label))


def test_each_field_brings_pairs_within_its_threshold_together():
    draw = np.random.default_rng(4)
    assert sum(f.t + 1 for f in FIELDS) == LINK + 1 and sum(f.width for f in FIELDS) == 64
    for f in (*FIELDS, Field(0, 24, 3, 2)):
        x = draw.integers(0, 2**64, 300, dtype=np.uint64)
        y = x.copy()
        for _ in range(f.t):
            y ^= np.uint64(1) << (np.uint64(f.low) + draw.integers(0, f.width, 300, dtype=np.uint64))
        row, home, anchor = f.anchors(x)
        homes = dict(zip(row[home].tolist(), anchor[home].tolist()))
        row, _, anchor = f.anchors(y)
        reached = set(zip(row.tolist(), anchor.tolist()))
        assert len(homes) == 300 and all((n, a) in reached for n, a in homes.items())


def test_one_document_of_each_group(make, odd):
    kept = anchors.one_per_group(make(odd)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [5, 8, 9, 10, 11, 12, 14, 15, 16]


def test_every_row_is_a_document_of_its_own(make):
    said = lambda k: " ".join(f"{k}word{i}" for i in range(200))
    rows = [(3, said("a")), (5, said("b")), (5, said("a") + " end"), (5, said("c")), (6, said("d"))]
    rows += [(None, said("e")), (None, said("f")), (None, said("f")), (None, said("d")), (6, said("d"))]
    got = anchors.one_per_group(make(rows))
    assert got.columns == make([]).columns
    kept = [rows[i] for i in (0, 1, 3, 4, 5, 6)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(kept, key=str)


def shingles(line):
    return {line[i : i + lines.SHINGLE] for i in range(max(1, len(line) - lines.SHINGLE + 1))}


def line_corpus(seed=5):
    draw = random.Random(seed)
    base = [" ".join(f"{draw.choice('abcdefghij')}{draw.randint(0, 9999)}" for _ in range(30)) for _ in range(30)]
    rows = []
    for i in range(40):
        own = []
        for line in draw.sample(base, 5):
            if draw.random() < 0.5:
                at = draw.randint(0, len(line) - 5)
                line = line[:at] + "zz" + line[at + 2 :]
            own.append(line)
        rows.append((i, "\n".join([*own, "", f"only here {i} {draw.random()}", "  same line  "])))
    return rows


def expected_lines(rows):
    places, seen = [], {}
    for n in keys(rows):
        for k, line in enumerate((rows[n][1] or "").split("\n")):
            line = line.strip(" \t\n\x0b\f\r")
            if line:
                places.append((n, k, line))
                seen.setdefault(line, len(seen))
    sets = [shingles(x) for x in seen]
    label = list(range(len(sets)))
    close = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in close:
            label[a] = label[b] = min(label[a], label[b])
    first, drop = set(), set()
    for n, k, line in places:
        c = label[seen[line]]
        drop.add((n, k)) if c in first else first.add(c)
    return {
        n: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (n, k) not in drop)
        for n, (_, t) in enumerate(rows)
    }


@pytest.mark.parametrize("held", [256, 2])
def test_fuzzy_lines(make, monkeypatch, held):
    monkeypatch.setattr(lines, "HELD", held)
    rows = line_corpus() + [(100, None), (101, ""), (102, " \n\n"), (103, "ab"), (104, "ab\nab"), (None, "ab")]
    out = lines.deduplicated(make(rows))
    assert {"packed", "gone", "version"} <= set(out.columns)
    wanted = expected_lines(rows)
    # Rows without id come first here, so the line of two letters stays in the last row.
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {rows[n][0]: t for n, t in wanted.items()}


def test_equal_rows_keep_their_lines_once(make):
    got = lines.deduplicated(make([(1, "x y\n\nz"), (1, "x y\n\nz"), (2, "z")])).select("doc_id", "text", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, "", 2), (1, "x y\n\nz", 0), (2, "", 1)]


@pytest.mark.parametrize("run", [relative.deduplicated, lines.deduplicated, anchors.near_duplicates, anchors.one_per_group])
def test_empty_tables(make, run):
    assert run(make([])).count() == 0


def test_components_of_chains_stars_and_loops(sent):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 100 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(sent.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {1000: 100}


def test_batches_that_cut_a_band_or_an_anchor(sent, make):
    before = sent.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sent.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = line_corpus(6)
        got = {r.doc_id: r.text for r in lines.deduplicated(make(rows)).collect()}
        assert got == {rows[n][0]: t for n, t in expected_lines(rows).items()}
        near = [(i, " ".join(f"v{k}" for k in range(400)) + f" end{i}") for i in range(12)]
        assert {r.component_id for r in anchors.near_duplicates(make(near)).collect()} == {0}
    finally:
        sent.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_many_equal_rows_are_told_their_lines_once(make, doc_id):
    seen = [f"line {n} with words of its own {n * 7919}" for n in range(20)]
    text = "\n".join([*seen, "a last line that nobody else has"])
    first = -5 if doc_id is None else 1
    rows = [(doc_id, text)] * 300 + [(first, "\n".join(seen))]
    out = lines.deduplicated(make(rows))
    got = Counter((r.doc_id, r.text, r.n_removed) for r in out.collect())
    if doc_id is None:  # rows without doc_id come first
        assert got == {(None, text, 0): 1, (None, "", 21): 299, (first, "", 20): 1}
    else:
        assert got == {(7, "a last line that nobody else has", 20): 1, (7, "", 21): 299, (first, "\n".join(seen), 0): 1}


def test_bands_of_the_very_same_lines_are_compared_once(spark, monkeypatch):
    words = " ".join(f"word{n}" for n in range(60))
    docs = spark.createDataFrame([(1, words), (2, words + "!"), (3, words + "?"), (4, "something else that is alone")], "doc_id long, text string")
    kept, write = {}, lines.durable

    def durable(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(lines, "durable", durable)
    out = {r.doc_id: r.n_removed for r in lines.deduplicated(docs).collect()}
    assert out == {1: 0, 2: 1, 3: 1, 4: 0}
    # Eight bands hold these three lines or two of them; of equal sets one is left.
    assert kept["buckets"].count() <= 4 and kept["bands"].count() >= 6


def test_texts_are_read_once_for_bands_and_places(spark, monkeypatch):
    rows = line_corpus(7)
    docs, plans, write = spark.createDataFrame(rows, "doc_id long, text string"), {}, lines.durable

    def durable(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(lines, "durable", durable)
    out = {r.doc_id: r.text for r in lines.deduplicated(docs).collect()}
    assert out == {rows[n][0]: t for n, t in expected_lines(rows).items()}
    # Only lines that have to be compared are read from the texts again.
    assert sum("LogicalRDD" in plan for plan in plans.values()) == 2


def test_each_two_lines_of_a_band_are_compared_once(monkeypatch):
    pairs, alike = [], lines._alike
    monkeypatch.setattr(lines, "_alike", lambda a, b: pairs.append(frozenset((a.tobytes(), b.tobytes()))) or alike(a, b))
    monkeypatch.setattr(lines, "AGREE", 0)
    texts = [f"{n} is no line like any of the others {n * 7919 ** 5}" * 3 for n in range(6)]
    found = lines.Lines(texts)
    band, sets, sketches = lines.Band(), found.sets(), found.sketches()
    assert [x.tolist() for x in sets] == [sorted(set(found.shingles()[0][s:e].tolist())) for s, e in zip(*found.shingles()[1:])]
    assert not band.hold([0, 1], sets[:2], sketches[:2]) and not band.hold([2, 3], sets[2:4], sketches[2:4])
    assert not band.links([4, 5], sets[4:], sketches[4:])
    assert len(pairs) == len(set(pairs)) == 6 + 2 * 4
