"""Maximum inner product search: score-aware (anisotropic) quantisation, four-bit table scans, bounds, exact reranking.

A vector's direction is coded as one of 16 centres in each small subspace, its length stays a number. Training and coding
minimise |r|^2 + (eta - 1) (r . x/|x|)^2 of the residual r, which penalises the part parallel to the vector,
since that part moves the large inner products. Two four-bit codes share a byte, so a scan adds up one
256-entry table a byte. Every vector is coded; only the codebook is learned from a bounded sample.

What the codes leave over is known: the length of the residual bounds how far a coded score is off. A scan keeps
what may still be among a query's best, whatever the rows look like, and scores it again with the residual in two bytes
a dimension, whose own rest is bounded alike. No fixed number of candidates cuts the list.

Codes, residuals and ids make up the index: two and a half bytes a dimension. A task meets one
lane of the index with one block of queries and sends on ids with their bounds. What may be among a query's best over all
lanes is then fetched by a join, and inner products are taken in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

CENTRES = 16
#: Vectors that the codebook is learned from, chosen by a hash of the id (expected number).
TRAIN_ROWS = 12_000
#: Share of a vector's length above which an inner product counts, which sets eta.
THRESHOLD = 0.2
#: Vectors of a block of the index, blocks of a lane (fewer beyond 64 dimensions), queries of a block, and of one table scan.
BLOCK_ROWS, LANE_BLOCKS, QUERY_ROWS, SCAN_QUERIES = 4096, 32, 1024, 256


class Codebook:
    """Centres of each subspace, learned with the anisotropic loss."""

    def __init__(self, dims: int, width: int = 1):
        self.parts = [np.arange(i, min(i + width, dims)) for i in range(0, dims, width)]
        self.dims = dims
        t2 = THRESHOLD**2
        self.eta = max(1.0, (dims - 1) * t2 / (1 - t2))
        self.centres: list[np.ndarray] = []

    def fit(self, x: np.ndarray, rounds: int = 6, seed: int = 7) -> Codebook:
        rng = np.random.default_rng(seed)
        self.centres = [x[rng.integers(0, len(x), CENTRES)][:, p].copy() for p in self.parts]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        for _ in range(rounds):
            codes, along = self._code(x, unit)
            for s, p in enumerate(self.parts):
                xs, us = x[:, p], unit[:, p]
                mine = ((xs - self.centres[s][codes[:, s]]) * us).sum(axis=1)
                rest = along - mine
                for c in range(CENTRES):
                    own = np.flatnonzero(codes[:, s] == c)
                    if not len(own):
                        self.centres[s][c] = xs[rng.integers(0, len(x))]
                        continue
                    u, e = us[own], self.eta - 1
                    left = len(own) * np.eye(len(p)) + e * u.T @ u
                    right = xs[own].sum(axis=0) + e * (u * (rest[own] + (xs[own] * u).sum(axis=1))[:, None]).sum(axis=0)
                    self.centres[s][c] = np.linalg.solve(left, right)
                along = rest + ((xs - self.centres[s][codes[:, s]]) * us).sum(axis=1)
        return self

    def _code(self, x: np.ndarray, unit: np.ndarray, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Codes by coordinate descent over the subspaces, and each residual's parallel part."""
        plain = [((x[:, None, p] - c[None]) ** 2).sum(axis=2) for p, c in zip(self.parts, self.centres, strict=True)]
        part = [((x[:, None, p] - c[None]) * unit[:, None, p]).sum(axis=2) for p, c in zip(self.parts, self.centres, strict=True)]
        codes = np.stack([d.argmin(axis=1) for d in plain], axis=1)
        rows = np.arange(len(x))
        along = sum(part[s][rows, codes[:, s]] for s in range(len(self.parts)))
        for _ in range(sweeps):
            for s in range(len(self.parts)):
                rest = along - part[s][rows, codes[:, s]]
                codes[:, s] = (plain[s] + (self.eta - 1) * (rest[:, None] + part[s]) ** 2).argmin(axis=1)
                along = rest + part[s][rows, codes[:, s]]
        return codes, along

    def code(self, x: np.ndarray) -> np.ndarray:
        """Packed codes, two subspaces a byte."""
        codes, _ = self._code(x, x / np.linalg.norm(x, axis=1, keepdims=True))
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), dtype=codes.dtype)], axis=1)
        return (codes[:, ::2] | (codes[:, 1::2] << 4)).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that packed codes stand for."""
        out = np.empty((len(codes), self.dims))
        for s, (p, c) in enumerate(zip(self.parts, self.centres, strict=True)):
            out[:, p] = c[(codes[:, s // 2] >> (4 * (s % 2))) & 15]
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(bytes, 256, queries): what each byte of a code adds to each query's score."""
        lut = [(c @ q[:, p].T).astype(np.float32) for p, c in zip(self.parts, self.centres, strict=True)]
        if len(lut) % 2:
            lut.append(np.zeros_like(lut[0]))
        return np.stack([(b[:, None] + a[None]).reshape(256, len(q)) for a, b in zip(lut[::2], lut[1::2], strict=True)])


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not zero."""
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)


def _cut(q: np.ndarray, i: np.ndarray, s: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` largest scores of each query, ties to the smaller id."""
    order = np.lexsort((i, -s, q))
    own = q[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own, side="left") < keep]


def _coded(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(rows, queries): coded scores."""
    score, step = (np.empty((len(codes), tables.shape[2]), dtype=np.float32) for _ in range(2))
    score[:] = 0
    for b, table in enumerate(tables):
        score += np.take(table, codes[:, b], axis=0, out=step, mode="clip")
    return score


def _own(ids: np.ndarray, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, query) at which a query meets its own id among sorted ``ids``."""
    first, last = np.searchsorted(ids, query_ids, side="left"), np.searchsorted(ids, query_ids, side="right")
    n = last - first
    return np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(len(query_ids)), n)


def scan(book: Codebook, blocks: list[tuple[np.ndarray, np.ndarray]], query_ids: np.ndarray, queries: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, coded score) of the ``keep`` best of all ``blocks`` (sorted ids, codes) for each query, itself excepted."""
    found = []
    for lo in range(0, len(queries), SCAN_QUERIES):
        own = query_ids[lo : lo + SCAN_QUERIES]
        tables = book.tables(queries[lo : lo + SCAN_QUERIES])
        q, i, s = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
        for ids, codes in blocks:
            score = _coded(tables, codes)
            score[_own(ids, own)] = -np.inf
            row, at = np.nonzero(score > -np.inf)
            q, i, s = np.concatenate((q, at)), np.concatenate((i, ids[row])), np.concatenate((s, score[row, at]))
            top = _cut(q, i, s, keep)
            q, i, s = q[top], i[top], s[top]
        found.append((q + lo, i, s))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Block:
    """Vectors of an index in the order of their ids: codes of directions, lengths, residuals in steps, and bounds for scores of a query of length one."""

    #: Arrays of a block with their types; codes and residuals have a row a vector.
    ARRAYS = {"ids": "<i8", "codes": "u1", "fine": "<i2", "length": "<f8", "step": "<f8", "coarse_miss": "<f8", "fine_miss": "<f8"}

    def __init__(self, book: Codebook, arrays: dict[str, bytes]):
        self.book = book
        for name, kind in self.ARRAYS.items():
            setattr(self, name, np.frombuffer(arrays[name], dtype=kind))
        self.codes, self.fine = self.codes.reshape(len(self.ids), -1), self.fine.reshape(len(self.ids), -1)

    @classmethod
    def of(cls, book: Codebook, ids: np.ndarray, x: np.ndarray) -> dict[str, bytes]:
        """The arrays of vectors ``x``."""
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        length = np.linalg.norm(x, axis=1)
        unit = x / length[:, None]
        codes = book.code(unit)
        rest = unit - book.decode(codes)
        step = np.abs(rest).max(axis=1, initial=0) / 32767
        fine = np.rint(rest / np.maximum(step, 1e-300)[:, None])
        miss, last = np.linalg.norm(rest, axis=1), np.linalg.norm(rest - fine * step[:, None], axis=1)
        # beside the residual, what tables in single and sums in double precision may be off
        single = 2.0**-23 * codes.shape[1] * np.sqrt(book.dims) * (1 + miss)
        got = {"ids": ids, "codes": codes, "fine": fine, "length": length, "step": step, "coarse_miss": length * (miss + single), "fine_miss": length * (last + 1e-13 * book.dims)}
        return {k: got[k].astype(kind).tobytes() for k, kind in cls.ARRAYS.items()}

    def refined(self, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """(rows, queries): scores with the residual."""
        x = self.book.decode(self.codes[rows]) + self.fine[rows] * self.step[rows, None]
        return (x @ queries.T) * self.length[rows, None]


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column, or minus infinity."""
    return np.partition(x, len(x) - k, axis=0)[len(x) - k] if len(x) >= k else np.full(x.shape[1], -np.inf)


def bounded(book: Codebook, blocks: list[Block], query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, least and largest possible score) of all that may be among the ``k`` best of ``blocks`` for each query, itself excepted."""
    found = []
    for start in range(0, len(queries), SCAN_QUERIES):
        own, asked = query_ids[start : start + SCAN_QUERIES], queries[start : start + SCAN_QUERIES]
        size = np.linalg.norm(asked, axis=1)
        asked = asked / size[:, None]
        tables = book.tables(asked)
        floor = np.full(len(own), -np.inf)
        q, i, low, high = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)
        for block in blocks:
            score = _coded(tables, block.codes) * block.length[:, None]
            itself = _own(block.ids, own)
            score[itself] = -np.inf
            floor = np.maximum(floor, _kth(score - block.coarse_miss[:, None], k))
            rows = np.flatnonzero((score + block.coarse_miss[:, None] >= floor).any(axis=1))
            score = np.full((len(block.ids), len(own)), -np.inf)
            score[rows] = block.refined(rows, asked)
            score[itself] = -np.inf
            score, miss = score[rows], block.fine_miss[rows]
            floor = np.maximum(floor, _kth(score - miss[:, None], k))
            row, at = np.nonzero((score + miss[:, None] >= floor) & (score > -np.inf))
            q, i = np.concatenate((q, at)), np.concatenate((i, block.ids[rows[row]]))
            low, high = np.concatenate((low, score[row, at] - miss[row])), np.concatenate((high, score[row, at] + miss[row]))
            order = np.lexsort((-low, q))
            last = order[np.arange(len(order)) - np.searchsorted(q[order], q[order], side="left") == k - 1]
            floor[q[last]] = np.maximum(floor[q[last]], low[last])
            live = high >= floor[q]
            q, i, low, high = q[live], i[live], low[live], high[live]
        found.append((q + start, i, low * size[q], high * size[q]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _search(base: DataFrame, asked: DataFrame, dims: int, rows: int, k: int, train_rows: int) -> DataFrame:
    """:func:`nearest` for usable vectors (id, v, copies) of one length and distinct queries (id, v) of that length."""
    unit = F.xxhash64("id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    sample = base.where(unit < F.lit(min(1.0, train_rows / rows))).orderBy("id").limit(2 * train_rows).select("v").toArrow()
    if not sample.num_rows:
        sample = base.limit(train_rows).select("v").toArrow()
    learned = _matrix(sample.column(0).combine_chunks(), dims)
    book = Codebook(dims).fit(learned / np.linalg.norm(learned, axis=1, keepdims=True))
    names = ["lane", *Block.ARRAYS]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            i, v, lane = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(lane[:1]), *[pa.array([x], pa.binary()) for x in Block.of(book, i, v).values()]], names=names)

        for batch in batches:
            i, v, lane = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), dims), batch.column(2).to_numpy(zero_copy_only=False)
            for lo in range(0, len(i), BLOCK_ROWS):
                held.append((i[lo : lo + BLOCK_ROWS], v[lo : lo + BLOCK_ROWS], lane[lo : lo + BLOCK_ROWS]))
                size += len(held[-1][0])
                if size >= BLOCK_ROWS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    parts = max(1, rows // BLOCK_ROWS)
    lane = F.floor(F.spark_partition_id() / max(1, LANE_BLOCKS * 64 // max(64, dims)))
    dealt = base.repartition(parts, "id", "v").select("id", "v", lane.alias("lane"))
    index = staged(dealt.mapInArrow(code, "lane bigint, " + ", ".join(f"{x} binary" for x in Block.ARRAYS)), "index")
    lanes = (index.agg(F.max("lane")).first()[0] or 0) + 1
    groups = max(1, asked.count() // QUERY_ROWS)
    query = asked.repartition(groups, "id").select("id", "v", F.pmod(F.spark_partition_id(), F.lit(groups)).alias("part"))
    query = query.select("id", "v", "part", F.explode(F.expr(f"sequence(0L, {lanes - 1}L)")).alias("lane"))
    codes = index.select("*", F.explode(F.expr(f"sequence(0, {groups - 1})")).alias("part"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = [Block(book, x) for x in left.select(list(Block.ARRAYS)).to_pylist()]
        form = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
        if not blocks or not right.num_rows:
            return form.empty_table()
        ids = right["id"].to_numpy()
        q, i, low, high = bounded(book, blocks, ids, _matrix(right["v"].combine_chunks(), dims), k)
        return pa.table([pa.array(ids[q]), pa.array(i), pa.array(low), pa.array(high)], schema=form)

    found = codes.groupBy("lane", "part").cogroup(query.groupBy("lane", "part")).applyInArrow(best, "query_id bigint, vec_id bigint, low double, high double")
    of_query = Window.partitionBy("query_id")
    placed = found.withColumn("n", F.row_number().over(of_query.orderBy(F.desc("low"), "vec_id")))
    floor = F.coalesce(F.max(F.when(F.col("n") == k, F.col("low"))).over(of_query), F.lit(float("-inf")))
    chosen = placed.withColumn("floor", floor).where("high >= floor").select("query_id", "vec_id").distinct()
    fetched = chosen.join(base.select(F.col("id").alias("vec_id"), "v", "copies"), "vec_id")
    both = fetched.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").select("query_id", "vec_id", "v", "q", "copies")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.einsum("ij,ij->i", _matrix(batch.column(2), dims), _matrix(batch.column(3), dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), batch.column(4)], names=["query_id", "vec_id", "score", "copies"])

    scored = both.mapInArrow(exact, "query_id bigint, vec_id bigint, score double, copies int")
    scored = scored.select("query_id", "vec_id", "score", F.explode(F.expr("sequence(1, copies)")).alias("copy"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Each query's ``k`` rows of largest inner product: query_id, rank, vec_id, score.

    A query is not its own answer (rows of its id are passed over); ties go to the smaller id. All that the bounds of the
    coded scores leave open is reranked exactly, so none is missed. Of equal vectors the ``k`` + 1 smallest ids
    are indexed, which are all that a query can find. Null or zero vectors, those
    with null or non-finite components and null ids take no part. Vectors of different lengths have no inner
    product, so each length is searched by itself. With nothing left the result is empty. Repeated ids are
    candidates each; of a repeated query id one vector asks. Very long vectors are coded like others. Other
    columns, whatever their names, are ignored.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    once = base.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    base = staged(once.withColumn("n", place).where(F.col("n") <= k + 1).drop("n"), "vectors")
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # one number for each length of vector
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = staged(asked.groupBy("id").agg(F.max("v").alias("v")), "asked")
    found = [_search(base.where(F.size("v") == r.d), asked.where(F.size("v") == r.d), r.d, r["count"], k, train_rows) for r in sizes]
    return reduce(DataFrame.unionByName, found)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
