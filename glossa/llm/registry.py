"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossa.llm.archive import op8_arc_to_warc
from glossa.llm.bpe import op9_bpe_rank_array
from glossa.llm.decontaminate import op4_simhash_windows
from glossa.llm.lm import op1_log_bilinear_nce
from glossa.llm.neardup import op7_prob_minhash
from glossa.llm.outliers import op2_minimum_covariance
from glossa.llm.quality import op6_naive_bayes_svm
from glossa.llm.sharding import op3_rendezvous_sharding
from glossa.llm.substring import op10_recompression
from glossa.llm.toxicity import op5_nonnegative_pu_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_log_bilinear_nce": op1_log_bilinear_nce,
        "op2_minimum_covariance": op2_minimum_covariance,
        "op3_rendezvous_sharding": op3_rendezvous_sharding,
        "op4_simhash_windows": op4_simhash_windows,
        "op5_nonnegative_pu_toxicity": op5_nonnegative_pu_toxicity,
        "op6_naive_bayes_svm": op6_naive_bayes_svm,
        "op7_prob_minhash": op7_prob_minhash,
        "op8_arc_to_warc": op8_arc_to_warc,
        "op9_bpe_rank_array": op9_bpe_rank_array,
        "op10_recompression": op10_recompression,
    }


def oracle_sql() -> dict[str, str]:
    return {}
