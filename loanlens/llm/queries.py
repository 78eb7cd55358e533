"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanlens.llm import bpe, embedding_dedup, fingerprints, line_dedup, mixing, ngram_join, quality, substring_dedup, target_resampling, topk_search, toxicity, url_filter, whitening
from loanlens.llm.shared import ship


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    run.__doc__ = f.__doc__
    return run


QUERIES = {
    "op1_quality": _query(quality.op1),
    "op2_substring_dedup": _query(substring_dedup.op2),
    "op3_url_filter": _query(url_filter.op3),
    "op4_bpe": _query(bpe.op4),
    "op5_embedding_dedup": _query(embedding_dedup.op5),
    "op6_mixing": _query(mixing.op6),
    "op7_line_dedup": _query(line_dedup.op7),
    "op8_ngram_join": _query(ngram_join.op8),
    "op9_topk_search": _query(topk_search.op9),
    "op10_toxicity": _query(toxicity.op10),
    "op11_fingerprints": _query(fingerprints.op11),
    "op12_whitening": _query(whitening.op12),
    "op13_target_resampling": _query(target_resampling.op13),
}

ORACLES = {
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op5_embedding_dedup": embedding_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op9_topk_search": topk_search.ORACLE,
    "op13_target_resampling": target_resampling.ORACLE,
}
