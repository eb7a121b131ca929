"""Row numbers over a whole table without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.session import shared_path


def numbered(df: DataFrame, *order: str | Column, name: str = "n", parts: int | None = None) -> DataFrame:
    """``df`` with ``name``, 0 for the first row in ``order``, which should be total.

    Rows are dealt over partitions by range and written, so that they stay there. Each partition numbers its own and
    starts from the rows in the partitions before: a prefix sum of one count a partition.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "numbered")
    df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.schema(StructType([*df.schema.fields, StructField("_part", IntegerType())])).parquet(path)
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")
