"""From raw documents to packed training sequences: five stages over whole tables.

Each stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents``, the last
one the packed pieces with the language of their document. Null texts have no letter, so the first stage drops them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wavecohort.llm import anchors, langid, lines, packing, relative
from wavecohort.llm.queries import tokenizer
from wavecohort.llm.shipping import ship
from wavecohort.session import durable, prepare


def _carried(docs: DataFrame) -> DataFrame:
    """``doc_id, text, carried``: the other columns aside, so that an operator's own columns don't replace them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*rest).alias("carried"))


def _restored(found: DataFrame, columns: list[str], counted: bool = True, lang: Column | None = None) -> DataFrame:
    """The columns of ``documents``, with ``n_chars`` of the text as it is now if ``counted``, and with ``lang`` if given."""
    now = {"text": F.col("text")}
    if counted:
        now["n_chars"] = F.char_length("text").cast("long")
    if lang is not None:
        now["lang"] = lang
    return found.select(*[now.get(c, F.col(f"carried.`{c}`")).alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identify the language of each document and drop those without one, whose text is null or has no letter.

    ``lang`` is the language identified from the text, whether a document came with a label or not. Labels are
    what the model learns from. A table without labels gives no model; its documents stay as they are.
    """
    ship(prepare(spark))
    model = langid.train(docs)
    found = langid.identify(_carried(docs), model).where(langid.lettered())
    identified = F.col("lang_pred").cast(docs.schema["lang"].dataType) if model else None
    return _restored(found, docs.columns, counted=False, lang=identified)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one line of each group of similar lines; documents stay, if only with fewer lines."""
    ship(prepare(spark))
    return _restored(lines.deduplicated(_carried(docs)), docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    ship(prepare(spark))
    return anchors.one_per_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out words of windows that start earlier."""
    ship(prepare(spark))
    return _restored(relative.deduplicated(_carried(docs)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all tokens into sequences; each piece has the language of its document."""
    ship(prepare(spark))
    return packing.packed(docs, tokenizer(), also=("lang",))


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", pack),
]

#: Hashes of XXH64, MinHash and a trained model are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    path = f"{sf_dir}/documents.parquet"
    docs = ship(prepare(spark, path)).read.parquet(path)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
