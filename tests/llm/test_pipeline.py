"""The pipeline's stages take effect, keep clean documents and follow each other."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(sent, tmp_path):
    draw = random.Random(2)
    said = lambda n: " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    clean = [(i, "\n".join(said(20) for _ in range(3))) for i in range(30)]
    passage = said(60)
    planted = [
        (100, clean[3][1]), (101, f"{said(30)} {passage}"), (102, f"{said(25)} {passage} {said(5)}"), (103, None), (104, "12 34"),
        (105, clean[4][1].split("\n")[0] + "\n" + said(40)),
    ]
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in clean + planted]
    folder = str(tmp_path)
    sent.createDataFrame(rows, FIELDS).write.parquet(f"{folder}/documents.parquet")
    docs = sent.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(sent, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = sent.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    names = list(seen)
    assert all(list(seen[n][0].asDict()) == [f.split()[0] for f in FIELDS.split(", ")] for n in names[:-1])
    assert set(seen["language_id"]) == {i for i, _ in clean + planted} - {103, 104}
    lines = seen["line_dedup"]
    assert lines[100].text == "" and lines[105].text == planted[5][1].split("\n")[1] and lines[105].n_chars == len(lines[105].text)
    assert all(lines[i].text == t for i, t in clean)
    assert set(seen["simhash_dedup"]) == set(lines)
    last = seen["substring_dedup"]
    assert passage in last[101].text and passage not in last[102].text and all(last[i].text == t for i, t in clean)
    assert set(seen["best_fit_packing"]) == set(last)
    run = corpus_pipeline.run(sent, folder)
    assert sorted(r.ids_crc32 for r in run.collect()) == sorted(r.ids_crc32 for r in docs.collect())


def test_tables_without_labels_keep_their_documents(sent, tmp_path):
    rows = [(1, "some words here", None, "s", 15), (2, None, None, "s", 0), (3, "12 34", None, "s", 5), (4, "other text", None, "s", 10)]
    folder = str(tmp_path)
    sent.createDataFrame(rows, FIELDS).write.parquet(f"{folder}/documents.parquet")
    docs = sent.read.parquet(f"{folder}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.language(sent, docs, folder).collect()) == [1, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.run(sent, folder).collect()) == [1, 4]


def test_language_identified_from_the_text_reaches_the_pieces(sent, tmp_path):
    draw = random.Random(5)
    words = {"en": "the house and with that which would have been there", "fr": "maison avec celle qui sont dans les nous pour être"}
    said = lambda lang: " ".join(draw.choice(words[lang].split()) for _ in range(40))
    true = {i: ("en", "fr")[i % 2] for i in range(44)}
    label = true | {40: None, 41: None, 42: "fr", 43: None}  # no label, or that of another language
    rows = [(i, said(true[i]), label[i], "s", 1) for i in true] + [(90, None, "en", "s", 0), (91, "12", None, "s", 2)]
    folder = str(tmp_path)
    sent.createDataFrame(rows, FIELDS).write.parquet(f"{folder}/documents.parquet")
    docs = sent.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.language(sent, docs, folder)
    assert out.dtypes == docs.dtypes and {r.doc_id: r.lang for r in out.collect()} == true
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(i, t, n) for i, t, _, _, n in rows if i in true}
    pieces = corpus_pipeline.run(sent, folder).collect()
    assert pieces and all(r.lang == true[r.doc_id] for r in pieces) and {"en", "fr"} == {r.lang for r in pieces}


def test_columns_of_the_input_keep_their_values(sent, tmp_path):
    own = ["n_removed", "n_lines", "n_words", "lang_pred", "lang_score", "carried", "rest", "doc", "copy"]
    same = "one line that comes again and again\nand another line below it"
    rows = [(i, t, "en", "s", len(t or ""), *[f"{c} {i}" for c in own]) for i, t in
            [(1, same), (2, same), (2, same), (None, "no id here but words"), (None, "no id here either, other words"), (3, None), (4, ""), (5, "w " * 3000)]]
    folder, fields = str(tmp_path), FIELDS + "".join(f", {c} string" for c in own)
    sent.createDataFrame(rows, fields).write.parquet(f"{folder}/documents.parquet")
    docs = sent.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(sent, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = sent.read.parquet(f"{folder}/{name}")
        assert all(getattr(r, c) == f"{c} {r.doc_id}" for r in docs.collect() for c in own), name
        assert docs.where("doc_id is null").count() == 2, name
    assert corpus_pipeline.pack(sent, docs, folder).where("doc_id is null").count() == 2


def test_an_empty_table(sent, tmp_path):
    folder = str(tmp_path)
    sent.createDataFrame([], FIELDS).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(sent, folder).count() == 0
