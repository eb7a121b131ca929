"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import clustering, exact_dedup, hard_negatives, language_id, language_model, mixing, near_dedup, packing, personal_data, sharding, token_counts, token_shards, vector_search
from tidemark.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def shipped(query: Query) -> Query:
    """``query``, with the package sent to the Python workers first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_token_shards": token_shards.op4_token_shards,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_personal_data": personal_data.op6_personal_data,
        "op7_lm_scores": language_model.op7_lm_scores,
        "op8_packing": packing.op8_packing,
        "op9_language_id": language_id.op9_language_id,
        "op10_nearest": vector_search.op10_nearest,
        "op11_clusters": clustering.op11_clusters,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_shards": sharding.op13_shards,
    }
    return {name: shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_dedup": near_dedup.OP2_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op11_clusters": clustering.OP11_SQL,
        "op12_hard_negatives": hard_negatives.OP12_SQL,
        "op13_shards": sharding.OP13_SQL,
    }
