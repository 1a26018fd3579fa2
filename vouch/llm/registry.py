"""The registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers

from vouch.llm import block_dedup, byte_bpe, exact_dedup, jaccard_join, lm_scoring, packing, periodic_runs, quality_rules, secret_scans, suffix_dedup, token_counts, toxicity, whitening
from vouch.llm.common import table, written


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark, sf_dir):
    return secret_scans.secret_digests(table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    """Trees of all texts are stored, and read again for the edits."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    stored = written(token_counts.with_trees(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), "trees", "zstd")
    return token_counts.edited_counts(token_counts.derived_edits(stored, "tree"), ranks, public_tokenizers.PATTERN, "tree").drop("tree")


def op4_quality_rules(spark, sf_dir):
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_block_dedup(spark, sf_dir):
    return block_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.digests(periodic_runs.with_runs(periodic_runs.looped_tails(table(spark, sf_dir, "documents"))))


def op12_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_lm_scoring(spark, sf_dir):
    return lm_scoring.scored(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries():
    return {"op1_suffix_dedup": op1_suffix_dedup, "op2_secret_scans": op2_secret_scans, "op3_token_counts": op3_token_counts, "op4_quality_rules": op4_quality_rules, "op5_jaccard_join": op5_jaccard_join, "op6_byte_bpe": op6_byte_bpe, "op7_packing": op7_packing, "op8_toxicity": op8_toxicity, "op9_exact_dedup": op9_exact_dedup, "op10_block_dedup": op10_block_dedup, "op11_periodic_runs": op11_periodic_runs, "op12_whitening": op12_whitening, "op13_lm_scoring": op13_lm_scoring, "pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"op9_exact_dedup": exact_dedup.ORACLE_SQL, "op10_block_dedup": block_dedup.ORACLE_SQL}
