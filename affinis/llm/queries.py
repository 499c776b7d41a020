"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from affinis.llm import (
    alignment, archives, decontamination, jaccard, language, lines, mixing, quality, ranking, rendering, sql, substrings, suffix_tree, tokens)
from affinis.llm.store import fresh


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_tree.held_out(F.col("doc_id"))
    model, counts = suffix_tree.learn(docs.where(~out))
    scored = suffix_tree.score(docs, model, counts)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    q = F.col("quality")
    return rated.select("doc_id", *(q[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > tokens.LIMIT)


def op8_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = fresh(spark, "arc"), fresh(spark, "warc")
    archives.write_arc(_table(spark, sf_dir, "pages"), arc)
    archives.to_warc(archives.read_arc(spark, arc), warc)
    return archives.read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.extract(_table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lines.line_counts(_table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
    aligned = alignment.align(_table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranking.build_index(_table(spark, sf_dir, "documents"))
    return ranking.search(index, _table(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = language.fold(F.col("doc_id"))
    model = language.learn(docs.where(~language.is_held_out(fold) & F.col("lang").isNotNull()))
    return language.predict(docs.withColumn("held_out", language.is_held_out(fold)), model).select("doc_id", "held_out", "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": sql.decontamination("documents"),
        "op3_mixing": sql.mixing("documents"),
        "op6_substring_dedup": sql.substring_dedup("documents"),
        "op8_archives": sql.archives(),
        "op10_line_dedup": sql.line_dedup("documents"),
        "op4_quality_rules": sql.quality("documents"),
        "op12_ranked_search": sql.ranking("documents", "benchmark"),
    }
