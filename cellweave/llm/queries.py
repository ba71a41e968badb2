"""One registered query per operator, each over its whole table with production parameters, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from cellweave.llm import (bpe, exact_dedup, hard_negatives, huffman, line_dedup, mixing, nearest, ngram_join, packing, periodic_runs,
                           suffix_dedup, token_counts, toxicity)
from cellweave.llm.common import table
from cellweave.session import scratch_path


def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op5_bpe(spark, sf_dir):
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_nearest_neighbours(spark, sf_dir):
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_line_dedup(spark, sf_dir):
    return line_dedup.drop_site_lines(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity(spark, sf_dir):
    return toxicity.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_ids(spark, sf_dir):
    folder = scratch_path(spark, "token-ids")
    huffman.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return huffman.read_ids(spark, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_hard_negatives(spark, sf_dir):
    turned = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(turned, F.col("vec_id") % 100 == 0)


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))))


def op13_source_mix(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"), mixing.WEIGHTS)


QUERIES = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_suffix_array_dedup": (op2_suffix_array_dedup, None),
    "op3_exact_dedup": (op3_exact_dedup, exact_dedup.ORACLE),
    "op4_ngram_jaccard_join": (op4_ngram_jaccard_join, None),
    "op5_bpe": (op5_bpe, None),
    "op6_nearest_neighbours": (op6_nearest_neighbours, None),
    "op7_line_dedup": (op7_line_dedup, line_dedup.ORACLE),
    "op8_best_fit_packing": (op8_best_fit_packing, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_token_ids": (op10_token_ids, None),
    "op11_hard_negatives": (op11_hard_negatives, hard_negatives.ORACLE),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_source_mix": (op13_source_mix, mixing.ORACLE),
}
