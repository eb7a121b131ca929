"""Joins of tables in which one key holds a third of the rows."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, near_dedup


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("binary", [False, True])
def test_spread_join(spark, how, binary):
    """Equal to a plain join, and the rows of the heavy key are dealt over tasks."""
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
    key = key.cast("string").cast("binary") if binary else key
    big = spark.range(30_000).select(key.alias("k"), "id")
    small = big.select("k").distinct().where(F.xxhash64("k") % 2 == 0).unionByName(big.where("id = 0").select("k")).distinct().withColumn("v", F.hex("k"))
    counted = big.groupBy("k").agg(F.count("*").alias("n"))
    got = common.spread_join(big, small, "k", "id", counted, 30_000, how)
    plain = big.join(small, "k", how)
    assert sorted(got.columns) == sorted(plain.columns)
    count = lambda df: collections.Counter(tuple(map(str, r)) for r in df.select(*plain.columns).collect())
    assert count(got) == count(plain)
    where = common.spread_join(big, small, "k", "id", counted, 30_000, how).where(F.hex("k") == F.hex(F.lit(7).cast("string").cast("binary") if binary else F.lit(7)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert where.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_components_of_a_star_with_most_of_the_edges(spark):
    """One node has two thirds of all links, beside many pairs and a chain."""
    star = spark.range(1, 4000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    pairs = spark.range(10_000, 12_000, 2).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    chain = spark.range(50_000, 50_300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = near_dedup.components(star.union(pairs).union(chain)).toPandas().set_index("id").component.to_dict()
    assert all(found[i] == 0 for i in range(4000)) and all(found[i] == found[i + 1] == i for i in range(10_000, 12_000, 2)) and {found[i] for i in range(50_000, 50_301)} == {50_000}


def test_a_worker_holds_the_table_of_one_step():
    from tidemark.llm import common

    one = common.worker_table(list, (1, 2))
    assert common.worker_table(list, (1, 2)) is one
    common.worker_table(set, (3,))
    assert len(common._TABLES) == 1 and common.worker_table(list, (1, 2)) is not one


def test_packing_with_a_small_word_cache(spark):
    import public_tokenizers

    from tests.conftest import DATA
    from tidemark.llm import packing
    from tidemark.llm.common import documents

    path, columns = public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    few, many = (sorted(map(tuple, packing.pack_documents(documents(spark, DATA), path, **more).select(columns).collect())) for more in ({"cache_entries": 200}, {}))
    assert few == many and few
