"""Centroid clustering by delta Lloyd: a round looks only at what the round before has changed.

Vectors are packed once into blocks of integers. Beside them lie the assignments, each vector's owner and the
squared distance to it, one small table a round. Both are bucketed by block, so that a round reads them side by
side without a shuffle. When some centroids have moved, a vector

* whose owner has not moved is compared with the moved centroids alone, as its owner still beats the others;
* whose owner has moved, but not away from it, likewise;
* whose owner has moved away is compared with all centroids.

Vectors that change their owner are taken off the sums of one centroid and added to those of another: blocks
report these signed integer transfers, whose total over all blocks is applied to the sums of the driver, one row
of numbers a centroid. Sums, floors and distances are integers, so the result does not depend on any order.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.integer_vectors import finite, floored, matrix, squared_distances, unpacked
from tidemark.session import shared_path

#: Vectors of a block, and blocks of a bucket.
BLOCK_ROWS, BUCKET_BLOCKS = 1024, 256
_STATE = "block bigint, owners binary, distances binary, transfers array<struct<c: int, s: array<bigint>>>"


class Clusters(NamedTuple):
    """``rows`` (id, cluster, distance), the final centroids, and the sum of distances of each."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int]


def assigned(x: np.ndarray, centroids: np.ndarray, moved: np.ndarray, owner: np.ndarray | None, distance: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Owners and squared distances of the vectors ``x`` after the centroids of the mask ``moved`` have moved.

    ``owner`` and ``distance`` are those before, or None. Ties go to the smaller number.
    """
    rows = np.arange(len(x))
    if owner is None:
        all_ = squared_distances(x, centroids)
        owner = all_.argmin(axis=1)
        return owner, all_[rows, owner]
    owner, distance = owner.copy(), distance.copy()
    dragged = np.flatnonzero(moved[owner])
    now = ((x[dragged].astype(np.int64) - centroids[owner[dragged]]) ** 2).sum(axis=1)
    farther = now > distance[dragged]
    distance[dragged] = now
    far = dragged[farther]
    if len(far):
        all_ = squared_distances(x[far], centroids)
        owner[far] = all_.argmin(axis=1)
        distance[far] = all_[np.arange(len(far)), owner[far]]
    near = np.setdiff1d(rows, far, assume_unique=True)
    numbers = np.flatnonzero(moved)
    if len(near) and len(numbers):
        some = squared_distances(x[near], centroids[numbers])
        at = some.argmin(axis=1)
        best, number = some[np.arange(len(near)), at], numbers[at]
        wins = (best < distance[near]) | ((best == distance[near]) & (number < owner[near]))
        owner[near[wins]], distance[near[wins]] = number[wins], best[wins]
    return owner, distance


def transfers(x: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> list[dict]:
    """What each centroid gains or loses: [count, sum of each component], signed, for centroids with a change."""
    x = x.astype(np.int64)
    with_count = np.concatenate((np.ones((len(x), 1), dtype=np.int64), x), axis=1)
    gone = np.flatnonzero(before != after) if before is not None else np.arange(len(x))
    out = {}
    for c in np.union1d(after[gone], before[gone] if before is not None else []).astype(int).tolist():
        out[c] = with_count[gone[after[gone] == c]].sum(axis=0)
        if before is not None:
            out[c] = out[c] - with_count[gone[before[gone] == c]].sum(axis=0)
    return [{"c": c, "s": s.tolist()} for c, s in out.items()]


class _Tables:
    """Bucketed tables of one run, under names of their own in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.run, self.names = spark, buckets, uuid.uuid4().hex, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table = f"delta_lloyd_{name}_{self.run}"
        df.write.bucketBy(self.buckets, "block").option("path", shared_path(self.spark, name)).option("compression", "zstd").format("parquet").saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def _packed(kept: DataFrame, dims: int) -> DataFrame:
    """Blocks (block, n, ids, x) of the rows (row, id, q); a block is named after its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                x = matrix(part.column(2), dims)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), pa.array([len(part)]), pa.array([part.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([x.astype("<i4").tobytes()], pa.binary())], names=["block", "n", "ids", "x"])

    return kept.select(F.monotonically_increasing_id().alias("row"), "id", "q").mapInArrow(run, "block bigint, n bigint, ids array<bigint>, x binary")


def delta_lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, factor: int = 1024, dims: int = 64, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters:
    """Lloyd's rounds over floor(``factor`` * x), integer centroids and exact ties.

    Vectors that are null, have another length than ``dims`` or a null or non-finite component take no part.
    The first centroids are the ``k`` vectors of smallest sha256 of ``seed:id`` (fewer, if there are fewer; repeated
    ids by their components, null ids last). Each of ``rounds`` assigns every vector to its nearest centroid (ties:
    the smaller number) and then moves every centroid that owns some to floor(sum / count); a last assignment
    follows. Repeated rows are vectors like others, null ids are carried along, other columns are ignored
    whatever their names, and an empty table gives an empty result. Rounds end early when nothing moves, as later
    ones would change nothing. Integers beyond 2^23 fail the job.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where((F.size("v") == dims) & finite(F.col("v"))).select("id", floored(F.col("v"), factor).alias("q"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = kept.orderBy(digest.asc_nulls_last(), "q").limit(k).collect()
    if not start:
        return Clusters(spark.createDataFrame([], "id bigint, cluster int, distance bigint"), np.zeros((0, dims), dtype=np.int64), [])
    centroids = np.array([r.q for r in start], dtype=np.int64)
    k = len(centroids)
    packed = staged(_packed(kept, dims), "vector-blocks")
    blocks = packed.count()
    tables = _Tables(spark, max(math.ceil(blocks / BUCKET_BLOCKS), min(blocks, 2 * spark.sparkContext.defaultParallelism)))
    base = tables.write(packed.repartition(tables.buckets, "block"), "vectors")

    def step(first: bool, centroids: np.ndarray, moved: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    x = unpacked(row["x"], dims)
                    before = None if first else np.frombuffer(row["owners"], dtype="<i4")
                    owner, distance = assigned(x, centroids, moved, before, None if first else np.frombuffer(row["distances"], dtype="<i8"))
                    moves = pa.array([transfers(x, before, owner)], pa.list_(pa.struct([("c", pa.int32()), ("s", pa.list_(pa.int64()))])))
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([owner.astype("<i4").tobytes()], pa.binary()), pa.array([distance.astype("<i8").tobytes()], pa.binary()), moves], names=["block", "owners", "distances", "transfers"])

        return run

    sums = np.zeros((k, dims + 1), dtype=np.int64)
    moved = np.ones(k, dtype=bool)
    state = tables.write(base.select("block", "x").mapInArrow(step(True, centroids, moved), _STATE), "state_0")
    for n in range(1, rounds + 1):
        # one number a centroid and component comes to the driver
        total = state.select(F.inline("transfers")).select("c", F.posexplode("s").alias("j", "v")).groupBy("c", "j").agg(F.sum("v").alias("v")).collect()
        for r in total:
            sums[r.c, r.j] += r.v
        target = centroids.copy()
        some = sums[:, 0] > 0
        target[some] = sums[some, 1:] // sums[some, :1]
        moved, centroids = (target != centroids).any(axis=1), target
        if not moved.any():
            break
        state = tables.write(base.select("block", "x").join(state.select("block", "owners", "distances").hint("shuffle_hash"), "block").mapInArrow(step(False, centroids, moved), _STATE), f"state_{n}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(np.frombuffer(row["owners"], dtype="<i4")), pa.array(np.frombuffer(row["distances"], dtype="<i8"))], names=["id", "cluster", "distance"])

    last = base.select("block", "ids").join(state.select("block", "owners", "distances").hint("shuffle_hash"), "block")
    result = staged(last.select("ids", "owners", "distances").mapInArrow(rows, "id bigint, cluster int, distance bigint"), "clusters")
    tables.drop()
    inertia = {r.cluster: r.s for r in result.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    return Clusters(result, centroids, [inertia.get(c, 0) for c in range(k)])


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = delta_lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    total = sum(found.inertia)
    facts = [(c, i, total, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, (row, i) in enumerate(zip(found.centroids, found.inertia, strict=True))]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")  # one row a centroid
    return found.rows.withColumnRenamed("id", "vec_id").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, factor: int = 1024, dims: int = 64, seed: str = "3") -> str:
    """The same rounds, written out."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM kept QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, min((d, c)) AS best FROM (
    SELECT kept.r, vec_id, kept.q, c, CAST(list_sum(list_transform(list_zip(kept.q, c{n}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept CROSS JOIN c{n}) GROUP BY r)"""
        )
        if n < rounds:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.q, c{n}.q) AS q FROM c{n} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT best[2] AS c, unnest(q) AS x, unnest(range({dims})) AS i FROM a{n}) GROUP BY c, i) GROUP BY c) m USING (c))"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = best[2]"""
    )


OP11_SQL = _sql()
