"""Registered queries of the text operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavecohort.llm import anchors, collide, crosstok, fingerprints, kneser, langid, lines, packing, pieces, relative, tokens, urls, whiten
from wavecohort.llm.shipping import ship
from wavecohort.session import prepare


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return ship(prepare(spark, path)).read.parquet(path)


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_threshold_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf, "documents"))


def op2_fuzzy_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = lines.deduplicated(_table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op3_collision_counts(spark: SparkSession, sf: str) -> DataFrame:
    return collide.near_vectors(_table(spark, sf, "embeddings"))


def op4_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").withColumn("held_out", langid.held_out("doc_id", 10))
    found = kneser.score(docs, kneser.train(docs.where("not held_out")))
    return found.withColumn("held_out", langid.held_out("doc_id", 10)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = relative.deduplicated(_table(spark, sf, "documents"))
    out = relative.words_digest(out, "text", "kept_sha256")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_simhash_anchors(spark: SparkSession, sf: str) -> DataFrame:
    found = anchors.near_duplicates(_table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    ids = pieces.encoded(_table(spark, sf, "documents").select("doc_id", "text"), model)
    back = pieces.decoded(ids, model)
    return back.select(
        "doc_id",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.xxhash64("piece_ids").alias("ids_digest"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("same_text"),
    )


def op8_language_families(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").withColumn("held_out", langid.held_out("doc_id", 5))
    model = langid.train(docs.where("not held_out"))
    found = langid.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op9_best_two_fit(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(_table(spark, sf, "documents"), tokenizer())


def op10_training_order(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.materialise(_table(spark, sf, "documents"), tokenizer())


#: Host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    pages = _table(spark, sf, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op12_identity_map(spark: SparkSession, sf: str) -> DataFrame:
    return crosstok.aligned(_table(spark, sf, "documents"), tokenizer(), tokenizer("piece_bpe_32k.model"))


def op13_jacobi_davidson(spark: SparkSession, sf: str) -> DataFrame:
    found = whiten.whitened(_table(spark, sf, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {f.__name__: f for f in (op1_threshold_sketch, op2_fuzzy_lines, op3_collision_counts, op4_kneser_ney, op5_substring_dedup, op6_simhash_anchors, op7_sentencepiece, op8_language_families, op9_best_two_fit, op10_training_order, op11_url_rules, op12_identity_map, op13_jacobi_davidson)}
ORACLE: dict[str, str] = {
    "op11_url_rules": r"""
WITH rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r, row_number() OVER () AS n FROM pages),
hosts AS (SELECT n, page_id, regexp_extract(r, '^[^/?#]*') AS raw, r FROM rest),
parts AS (
    SELECT n, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path
    FROM hosts),
fits AS (
    SELECT n, arg_max(struct_pack(rule := h || p, verdict := v), length(h || p)) AS best
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (n)
""",
}
