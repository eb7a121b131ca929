"""Clustering, hard negatives and sharding on odd rows, against brute force. Their queries meet their SQL in test_operators."""

from __future__ import annotations

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import clustering, hard_negatives, sharding
from tidemark.llm.integer_vectors import products, squared_distances


def vector_rows(n: int = 400, dims: int = 64, seed: int = 5) -> list[tuple]:
    """Clustered vectors with repeated rows, one value that a third of the rows hold, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (6, dims))
    x = (centres[rng.integers(0, 6, n)] + rng.normal(0, 0.05, (n, dims))).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, x[1][:32].tolist(), 2), (n + 3, [None, *x[1][1:].tolist()], 1), (n + 4, [float("nan"), *x[1][1:].tolist()], 1), (n + 5, [float("inf"), *x[1][1:].tolist()], 1), (n + 6, x[2].tolist(), None)]
    return [*rows, rows[7], (None, x[3].tolist(), 1), *odd]


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return df.withColumn("id", F.lit("clash")).withColumn("cluster", F.lit(1)).withColumn("score", F.lit(1)).withColumn("block", F.lit(1)).repartition(5)


def whole(v, factor: int) -> tuple[int, ...]:
    return tuple(int(np.floor(factor * np.float64(np.float32(x)))) for x in v)


def finite(v) -> bool:
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_exact_arithmetic():
    rng = np.random.default_rng(1)
    for top in (100, 1 << 22):  # the second is beyond what doubles hold
        a, b = rng.integers(-top, top, (7, 600)), rng.integers(-top, top, (5, 600))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert products(a, b).tolist() == want
        far = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert squared_distances(a, b).tolist() == far


def plain_lloyd(rows, k, rounds, factor=1024, dims=64):
    kept = [(i, whole(v, factor)) for i, v, _ in rows if finite(v) and len(v) == dims]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centres = [list(q) for _, q in first[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, q in kept:
            own[nearest(q)[1]].append(q)
        for n, members in own.items():
            centres[n] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    return sorted((i if i is not None else -1, nearest(q)[1], nearest(q)[0]) for i, q in kept), centres


def test_delta_lloyd_equals_plain_rounds(spark):
    rows = vector_rows()
    for k, rounds in ((8, 4), (3, 20)):
        found = clustering.delta_lloyd(table(spark, rows), k=k, rounds=rounds)
        want, centres = plain_lloyd(rows, k, rounds)
        assert sorted((r.id if r.id is not None else -1, r.cluster, r.distance) for r in found.rows.collect()) == want
        assert found.centroids.tolist() == centres and sum(found.inertia) == sum(d for _, _, d in want)


def test_delta_lloyd_of_few_and_of_none(spark):
    few = table(spark, vector_rows(9)[:2])
    assert sorted((r.id, r.distance) for r in clustering.delta_lloyd(few).rows.collect()) == [(0, 0), (1, 0)]
    assert clustering.delta_lloyd(few.where("false")).rows.count() == 0
    with pytest.raises(Exception, match="exceeds"):
        clustering.delta_lloyd(table(spark, [(1, [1e30] * 64, 1)]))


def test_a_round_looks_at_what_moved():
    """Owners after a move equal a full comparison, with ties."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, before = rng.integers(-3, 4, (60, 3)), rng.integers(-3, 4, (6, 3))
        owner, distance = clustering.assigned(x, before, np.ones(6, dtype=bool), None, None)
        moved = rng.random(6) < 0.4
        after = np.where(moved[:, None], rng.integers(-3, 4, (6, 3)), before)
        got = clustering.assigned(x, after, moved, owner, distance)
        want = clustering.assigned(x, after, moved, None, None)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        sums = np.zeros((6, 4), dtype=np.int64)
        for changes in (clustering.transfers(x, None, owner), clustering.transfers(x, owner, got[0])):
            for t in changes:
                sums[t["c"]] += t["s"]
        assert sums.tolist() == [[(got[0] == c).sum(), *x[got[0] == c].sum(axis=0)] for c in range(6)]


def plain_negatives(rows, is_anchor, n_positives=5, n_negatives=10, window=(30, 90)):
    usable = [(i, whole(v, 256), lab) for i, v, lab in rows if i is not None and lab is not None and finite(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    anchors = {}
    for i, q, lab in usable:
        if is_anchor(i):
            anchors[i] = max(anchors.get(i, (q, lab)), (q, lab))
    out = []
    for i, (q, lab) in anchors.items():
        scored = sorted((-dot(q, p), j, own) for j, p, own in usable if j != i and len(p) == len(q))
        for n, (ps, j, _) in enumerate([x for x in scored if x[2] == lab][:n_positives], 1):
            fits = [x for x in scored if x[2] != lab and window[0] * -ps <= 100 * -x[0] <= window[1] * -ps]
            out += [(i, j, n, m, k, -ps, -s) for m, (s, k, _) in enumerate(fits[:n_negatives], 1)]
    return sorted(out)


def test_hard_negatives_equal_all_products(spark, monkeypatch):
    """Small blocks and panels, so that tiles, chunks and panels meet; with repeated anchors and vectors of two lengths."""
    for name, value in (("BLOCK_ROWS", 64), ("BLOCK_ANCHORS", 7), ("PANEL_ANCHORS", 16), ("CHUNK_DIMS", 24)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vector_rows(300)
    rows += [(10, rows[4][1], 2), (500, rows[5][1][:32], 1), (501, rows[6][1][:32], 1), (502, rows[8][1][:32], 0), (1000, [], 1), (1001, [], 1), (1002, [], 2)]
    vectors = table(spark, rows)
    got = hard_negatives.hard_negatives(vectors, vectors.where(F.col("vec_id") % 10 == 0))
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 300 and sorted(tuple(r) for r in got.collect()) == want
    few = hard_negatives.hard_negatives(vectors, vectors.where(F.col("vec_id") % 50 == 0), 2, 3, (0, 100))
    assert sorted(tuple(r) for r in few.collect()) == plain_negatives(rows, lambda i: i % 50 == 0, 2, 3, (0, 100))
    assert hard_negatives.hard_negatives(vectors.where("false"), vectors.where("false")).count() == 0


ODD_DOCS = [(1, None, "a"), (2, "", "a"), (3, "é" * 9, None), (4, "long " * 100_000, ""), (None, "x", "b"), (None, None, None), (5, "same", "b"), (6, "same", "b")]


def documents(spark, copies: int = 3000):
    """Odd rows, many copies of one row, and sources of very different size."""
    rows = [*ODD_DOCS, *[(7, "copy", "hot")] * copies, *[(100 + i, f"text {i}", f"s{i % 7 if i % 3 else 0}") for i in range(900)], *[(5000 + i, "t", f"lone{i}") for i in range(60)]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return rows, df.withColumn("shard", F.lit("clash")).withColumn("stratum", F.lit(1)).withColumn("size", F.lit(2)).repartition(6)


def test_every_shard_has_the_mixture(spark):
    rows, docs = documents(spark)
    got = sharding.interleaved(sharding.described(docs), shards=10).toPandas()
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "none" if s is None else f"s:{s}") for i, t, s in rows)
    found = collections.Counter((None if i != i else int(i), n, c, s) for i, n, c, s in got[["id", "size", "text_crc32", "stratum"]].itertuples(index=False))
    assert found == want
    assert sorted(got.position) == list(range(len(rows)))
    assert all(sorted(own) == list(range(len(own))) for _, own in got.groupby("shard").slot)
    counts = got.groupby("shard").size()
    assert len(counts) == 10 and counts.max() - counts.min() <= 1
    for source, own in got.groupby("stratum"):
        per = [(own["shard"] == s).sum() for s in range(10)]
        # a stretch of the fractions holds a source's share of it, give or take one; cuts of equal counts differ from equal
        # fractions by less than one row a source
        assert max(per) - min(per) <= 2 + len(own) * 71 / len(rows), source
    assert sharding.interleaved(sharding.described(docs.where("false"))).count() == 0


def test_order_is_that_of_the_seed(spark):
    _, docs = documents(spark, 10)
    place = lambda d, seed: [tuple(r) for r in sharding.interleaved(sharding.described(d), 5, seed).orderBy("position").select("id", "stratum").collect()]
    assert place(docs, "a") == place(docs.repartition(2), "a") != place(docs, "b")


def test_written_shards_hold_all_rows_in_order(spark, tmp_path):
    rows, docs = documents(spark, 200)
    read = sharding.write_shards(docs, str(tmp_path / "shards"), shards=6)
    assert read.columns == [*docs.columns, "_slot", "_shard"] or read.columns == [*docs.columns, "_shard", "_slot"]
    assert collections.Counter((r.doc_id, r.text, r.source) for r in read.collect()) == collections.Counter(rows)
    slots = read.where("_shard = 3").orderBy(F.input_file_name(), F.monotonically_increasing_id()).select("_slot").collect()
    assert [r._slot for r in slots] == list(range(len(slots)))
    placed = {(r.doc_id, r._shard, r._slot) for r in read.collect()}
    assert placed == {(r.id, r.shard, r.slot) for r in sharding.interleaved(sharding.described(docs), 6).collect()}
