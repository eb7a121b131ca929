"""Shared helpers of the corpus operators: staged tables, Arrow batch access, worker caches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_path

#: Text handed to one vectorised step inside a task; bounds worker memory whatever the row sizes are.
SLICE_BYTES = 1 << 20
#: A key with more than this part of all rows is heavy; a heavy key is dealt over so many parts.
HEAVY, SPREAD = 512, 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_column(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about ``limit`` (a larger item stands alone)."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def looked_up(texts: list[bytes], table: dict, split: Callable[[bytes], list[bytes]]) -> Iterator[Iterable]:
    """The table's values for the parts of each text.

    ``table.learn(parts)`` adds parts that it lacks, and says whether it had to drop others for that.
    """
    for lo, hi in slices([len(x) for x in texts]):
        parts = [split(x) for x in texts[lo:hi]]
        found: list[Iterable] = [list(map(table.get, own)) for own in parts]
        open_ = [i for i, got in enumerate(found) if None in got]
        if open_:
            if table.learn({x for i in open_ for x, got in zip(parts[i], found[i], strict=True) if got is None}):
                table.learn({x for i in open_ for x in parts[i]})
            for i in open_:
                found[i] = map(table.__getitem__, parts[i])
        yield from found


def spread_join(big: DataFrame, small: DataFrame, on: str, by: str, counted: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """``big`` and ``small`` joined on ``on``; keys with more than 1 / ``HEAVY`` of ``total`` rows are dealt over ``SPREAD`` parts by ``by``.

    ``counted`` has (on, n), the rows of ``big`` by key, and their sum is ``total`` at most; so there are fewer than
    ``HEAVY`` such keys, and the driver may name them whatever the size of the tables.
    """
    heavy = [r[0] for r in counted.where(F.col("n") * HEAVY > total).select(on).collect()]
    if not heavy:
        return big.join(small, on, how)
    is_heavy = F.col(on).isin([bytes(k) if isinstance(k, bytearray) else k for k in heavy])
    left = big.withColumn("_part", F.when(is_heavy, F.pmod(F.xxhash64(by), F.lit(SPREAD))).otherwise(0).cast("int"))
    right = small.withColumn("_part", F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [on, "_part"], how).drop("_part")


_TABLES: dict[tuple, object] = {}


def worker_table(make: Callable, *args):
    """``make(*args)`` of this worker, which its tasks share; tables of other steps, which have ended, go, and their memory with them."""
    key = (make, args)
    if key not in _TABLES:
        _TABLES.clear()
        pa.default_memory_pool().release_unused()
        _TABLES[key] = make(*args)
    return _TABLES[key]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
