"""The queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import decontamination, license_scan, line_dedup, lm_scoring, mixing, pii, prefix_trie, quality, simhash, suffix_dedup, token_counts, vector_neighbours, whitening
from strandframe.llm._common import table

OVER = 1024
BPE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))
    return counted.withColumn("over_limit", F.col("n_tokens") > OVER)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("sig")).alias("fingerprint"), "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.scores(table(spark, sf_dir, "documents"))
    return scored.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents"), spans_col="spans")
    return done.select("doc_id", F.size("spans").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("spans.type")), ",").alias("types"), "text")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "n_units", "n_removed", "n_shared", "shared_words", "longest_shared", F.sha2(text, 256).alias("kept_sha256"), text.alias("kept_text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.verdicts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_FILE))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy", "script")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_license_scan, op3_simhash, op4_suffix_dedup, op5_lm_scoring, op6_pii_surrogates, op7_source_mix, op8_line_dedup, op9_decontamination, op10_quality_rules)
    own += (op11_prefix_trie, op12_whitening, op13_vector_neighbours,)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_lm_scoring": lm_scoring.SCORES_SQL,
        "op7_source_mix": mixing.MIX_SQL.format(docs="documents", more=""),
        "op8_line_dedup": line_dedup.REPEATS_SQL,
        "op11_prefix_trie": prefix_trie.TRIE_SQL,
        "op13_vector_neighbours": vector_neighbours.ALL_PAIRS_SQL,
    }
