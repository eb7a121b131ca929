"""Hard negatives by a two-dimensional block matrix multiply.

Rows are sharded into blocks and their dimensions into chunks; a piece is one block's chunk. Anchors are taken a
panel at a time, bounded in bytes, and each task multiplies pieces of rows with the same chunk of the panel. The
partial score tiles, one for each (block of rows, block of anchors, chunk), meet by block and are added up in 64-bit
integers; on the way each travels in the narrowest integers that hold it. The sums are staged, and reduced twice: to
each anchor's positives, which are few, and then to the best rows of the window that each positive opens.

What a task holds is a few tiles, whatever the number of rows; what is shuffled is proportional to rows times
anchors, as the scores are, and a panel's tiles are gone from the plan before the next panel starts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.integer_vectors import finite, floored, matrix, products, unpacked

#: Rows of a block, anchors of a block and of a panel, dimensions of a chunk (more where there would be over MOST_CHUNKS).
BLOCK_ROWS, BLOCK_ANCHORS, PANEL_ANCHORS, CHUNK_DIMS, MOST_CHUNKS = 2048, 256, 1024, 32, 4
#: Bytes of a panel's components at most; a wider vector makes panels of fewer anchors.
PANEL_BYTES = 8 << 20
_PIECE = "block bigint, chunk int, ids binary, labels binary, x binary"
_TILE = "block bigint, part int, ids binary, labels binary, scores binary, width int"


def _chunks(dims: int) -> list[slice]:
    width = max(CHUNK_DIMS, -(-dims // MOST_CHUNKS))
    return [slice(i, min(i + width, dims)) for i in range(0, max(dims, 1), width)]


def _narrow(tile: np.ndarray) -> np.ndarray:
    most = int(np.abs(tile).max(initial=0))
    return tile.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def _tile(data: bytes, width: int, rows: int) -> np.ndarray:
    """(anchors, rows) of a tile whose integers take ``width`` bytes."""
    return np.frombuffer(data, dtype=f"<i{width}").reshape(-1, rows)


def _pieces(rows: DataFrame, dims: int) -> DataFrame:
    """Pieces of the rows (row, id, label, q): the first chunk of a block carries its ids and labels."""
    size, chunks = BLOCK_ROWS, _chunks(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), size):
                part = batch.slice(lo, size)
                x = matrix(part.column(3), dims)
                ids, labels = (part.column(i).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for i in (1, 2))
                for n, chunk in enumerate(chunks):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(0, 1), pa.array([n], pa.int32()), pa.array([ids if n == 0 else None], pa.binary()), pa.array([labels if n == 0 else None], pa.binary()), pa.array([np.ascontiguousarray(x[:, chunk]).astype("<i4").tobytes()], pa.binary())],
                        names=["block", "chunk", "ids", "labels", "x"],
                    )

    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "q").mapInArrow(run, _PIECE)


def _partial(pieces: DataFrame, panel: np.ndarray) -> DataFrame:
    """Partial score tiles of all pieces with the same chunk of the panel."""
    dims = panel.shape[1]
    size, chunks = BLOCK_ANCHORS, _chunks(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = chunks[row["chunk"]]
                x = unpacked(row["x"], chunk.stop - chunk.start) if dims else np.zeros((len(row["ids"]) // 8, 0), dtype=np.int32)
                for part, lo in enumerate(range(0, len(panel), size)):
                    tile = _narrow(products(panel[lo : lo + size, chunk], x))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"]]), pa.array([part], pa.int32()), pa.array([row["ids"]], pa.binary()), pa.array([row["labels"]], pa.binary()), pa.array([tile.tobytes()], pa.binary()), pa.array([tile.itemsize], pa.int32())],
                        names=["block", "part", "ids", "labels", "scores", "width"],
                    )

    return pieces.mapInArrow(run, _TILE)


def _added(tiles: pa.Table) -> pa.Table:
    """The sum of the partial tiles of one (block, part)."""
    rows = tiles.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    n = len(head["ids"]) // 8
    total = np.zeros(_tile(rows[0]["scores"], rows[0]["width"], n).shape, dtype=np.int64)
    for r in rows:
        total += _tile(r["scores"], r["width"], n)
    total = _narrow(total)
    return pa.table(
        [pa.array([head["block"]]), pa.array([head["part"]], pa.int32()), pa.array([head["ids"]], pa.binary()), pa.array([head["labels"]], pa.binary()), pa.array([total.tobytes()], pa.binary()), pa.array([total.itemsize], pa.int32())],
        names=["block", "part", "ids", "labels", "scores", "width"],
    )


def best_positives(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, anchor: int, label: int, keep: int) -> np.ndarray:
    """Places of the first ``keep`` other rows of the anchor's label: higher scores first, ties by smaller id."""
    own = np.flatnonzero((labels == label) & (ids != anchor))
    return own[np.lexsort((ids[own], -scores[own]))[:keep]]


def best_negatives(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, label: int, positives: list[int], window: tuple[int, int], keep: int) -> list[np.ndarray]:
    """For each positive's score, places of the first ``keep`` rows of another label with lo * positive <= 100 * score <= hi * positive."""
    other = np.flatnonzero(labels != label)
    top = max((window[1] * p for p in positives), default=0)
    least = min((window[0] * p for p in positives), default=0)
    other = other[(100 * scores[other] <= top) & (100 * scores[other] >= least)]
    order = other[np.lexsort((ids[other], -scores[other]))]
    falling = -100 * scores[order]
    found = []
    for p in positives:
        first, last = np.searchsorted(falling, -window[1] * p, side="left"), np.searchsorted(falling, -window[0] * p, side="right")
        found.append(order[first : min(last, first + keep)])
    return found


def _reduced(tiles: DataFrame, names: list[str], pick) -> DataFrame:
    """Rows that ``pick(part, ids, labels, scores)`` finds in each summed tile, as columns of 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["labels"], dtype="<i8")
                found = pick(row["part"], ids, labels, _tile(row["scores"], row["width"], len(ids)))
                if found:
                    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    return tiles.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _mined(pieces: DataFrame, ids: np.ndarray, labels: np.ndarray, panel: np.ndarray, n_positives: int, n_negatives: int, window: tuple[int, int]) -> DataFrame:
    """The result for one panel of anchors."""
    size = BLOCK_ANCHORS
    tiles = staged(_partial(pieces, panel).groupBy("block", "part").applyInArrow(_added, _TILE), "score-tiles")

    def positives(part: int, own: np.ndarray, marks: np.ndarray, tile: np.ndarray) -> list[tuple]:
        out = []
        for i, scores in enumerate(tile.astype(np.int64), part * size):
            at = best_positives(own, marks, scores, ids[i], labels[i], n_positives)
            out.append((np.full(len(at), i), own[at], scores[at]))
        return out

    by_score = lambda *key, row: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), row))
    near = _reduced(tiles, ["anchor", "positive_id", "score"], positives).withColumn("n", by_score("anchor", row="positive_id")).where(F.col("n") <= n_positives)
    # PANEL_ANCHORS times n_positives rows at most
    held: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for r in near.orderBy("anchor", "n").collect():
        held[r.anchor].append((r.n, r.positive_id, r.score))

    def negatives(part: int, own: np.ndarray, marks: np.ndarray, tile: np.ndarray) -> list[tuple]:
        out = []
        for i, scores in enumerate(tile.astype(np.int64), part * size):
            found = best_negatives(own, marks, scores, labels[i], [s for _, _, s in held[i]], window, n_negatives)
            for (n, _, _), at in zip(held[i], found, strict=True):
                out.append((np.full(len(at), i), np.full(len(at), n), own[at], scores[at]))
        return out

    far = _reduced(tiles, ["anchor", "n", "negative_id", "score"], negatives).withColumn("rank", by_score("anchor", "n", row="negative_id")).where(F.col("rank") <= n_negatives)
    facts = [(i, int(ids[i]), n, p, s) for i, own in held.items() for n, p, s in own]
    about = far.sparkSession.createDataFrame(facts, "anchor bigint, anchor_id bigint, n bigint, positive_id bigint, positive_score bigint")
    return far.join(F.broadcast(about), ["anchor", "n"]).select("anchor_id", "positive_id", F.col("n").cast("int").alias("positive_rank"), F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 10, window: tuple[int, int] = (30, 90), factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    A score is the inner product of floor(``factor`` * x) of both vectors. An anchor's positives are its first
    ``n_positives`` rows of the same label, its negatives for a positive the first ``n_negatives`` of other labels
    with window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score; higher scores come
    first, ties by the smaller id. ``anchors`` has rows of the same form; a null id, label or vector, or a null or
    non-finite component keeps a row out. Rows of an anchor's id are passed over; of a repeated anchor id one vector
    asks (its largest), repeated rows are candidates each. Vectors of different lengths have no product, so each length
    is mined by itself. An anchor without positives or negatives has no rows, an empty table gives an empty
    result, other columns are ignored whatever their names, and integers beyond 2^23 fail the job.
    """

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
        return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v"))).select("id", "label", floored(F.col("v"), factor).alias("q"))

    rows = staged(usable(vectors), "integer-vectors")
    asked = staged(usable(anchors).groupBy("id").agg(F.max(F.struct("q", "label")).alias("x")).select("id", "x.label", "x.q"), "anchors")
    found = []
    # one row for each length of vector
    for r in asked.groupBy(F.size("q").alias("d")).count().orderBy("d").collect():
        d, own = r.d, asked.where(F.size("q") == r.d)
        pieces = staged(_pieces(rows.where(F.size("q") == d), d), "pieces")
        size = max(1, min(PANEL_ANCHORS, PANEL_BYTES // (4 * max(d, 1))))
        panels = -(-r["count"] // size)
        # panels of about equal size by ranges of a hash; each is at most a few standard deviations over its mean
        part = F.pmod(F.xxhash64("id"), F.lit(panels)).cast("int")
        for n in range(panels):
            panel = own.where(part == n).orderBy("id").toArrow()
            if panel.num_rows:
                x = matrix(panel["q"].combine_chunks(), d)
                found.append(staged(_mined(pieces, panel["id"].to_numpy(), panel["label"].to_numpy(), x, n_positives, n_negatives, window), "negatives"))
    if not found:
        return vectors.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, positive_rank int, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return reduce(DataFrame.unionByName, found)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS positive_rank
  FROM s WHERE same QUALIFY positive_rank <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score, CAST(positive_rank AS INTEGER) AS positive_rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
