"""Near-duplicate detection: fast similarity sketches, banding, exact verification, components.

A sketch has ``BINS`` coordinates. In round i < BINS every shingle is thrown into one bin by a hash of
that round, and a bin keeps the smallest hash of the first round that reached it; in round BINS + b all
shingles meet in bin b. So each coordinate is filled however small the set is, and for large sets one
or two rounds do. Documents with equal shingle sets form a class first, and only its smallest id goes
on. Band keys of four coordinates put classes into buckets.

Within a bucket each member is verified against the bucket's smallest id alone, which is linear in the
bucket. Buckets whose members then lie in different components are looked at again: of their pairs in
different components, those that exact bounds leave are verified as well: distances to the common
bucket leader may differ by no more than the link distance (Jaccard distance is a metric), and the
overlap must be possible (see :func:`remaining_pairs`). No link between bucket mates is lost, and copies
are never expanded into all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_column, documents, slices, spread_join, staged

SHINGLE = 5
PERCENT = 75
BINS, ROWS = 128, 4
WORD_CACHE = 200_000
#: Shingles that so many of the documents in question have at most are rare.
RARE = 8
#: Rows of a bucket that one task pairs with the rest of it.
BUCKET_ROWS = 512
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Lower-cased word to a 64-bit hash, bounded in size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def shingle_sets(texts: list[bytes], table: WordHashes, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [x.lower().split() for x in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((table[x] for own in words for x in own), dtype=np.uint64, count=int(counts.sum()))
    ends = np.cumsum(counts)
    rolled = np.zeros(max(len(flat) - size + 1, 0), dtype=np.uint64)
    for i in range(size):
        rolled = rolled * _STEP + flat[i : i + len(rolled)]
    rolled = _mix(rolled)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(rolled[end - n : end - size + 1]))
        elif n:
            value = np.array([n], dtype=np.uint64)
            for i in range(end - n, end):
                value = _mix(value * _STEP + flat[i : i + 1])
            out.append(value)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` filled coordinates per set (rows of empty sets stay unset)."""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    items = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full(len(sets) * bins, _NONE, dtype=np.uint64)
    filled = np.zeros(len(out), dtype=bool)
    for r in range(2 * bins):
        if not len(items):
            break
        value = _mix(items + np.uint64((r + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        at = owner * bins + ((value >> shift).astype(np.int64) if r < bins else r - bins)
        free = ~filled[at]
        at = at[free]
        np.minimum.at(out, at, value[free])
        filled[at] = True
        open_ = ~filled.reshape(-1, bins).all(axis=1)[owner]
        if not open_.all():
            items, owner = items[open_], owner[open_]
    return out.reshape(-1, bins)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """64-bit keys of the bands, one column per band; the band's number is part of the key."""
    n, bins = sketch.shape
    parts = sketch.reshape(n, bins // rows, rows)
    key = np.broadcast_to(np.arange(1, bins // rows + 1, dtype=np.uint64), (n, bins // rows)).copy()
    for i in range(rows):
        key = _mix(key * _STEP + parts[:, :, i])
    return key.view(np.int64)


def sketch_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null for an empty one), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            texts = byte_column(batch.column(1))
            for lo, hi in slices([len(x) for x in texts]):
                sets = shingle_sets(texts[lo:hi], table)
                keys = band_keys(sketches(sets))
                width = keys.shape[1]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                offsets = pa.array(np.arange(0, len(sets) * width + 1, width), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel(), pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, both, either): sizes of intersection and union of the full sets of each pair.

    ``texts`` has (id, text). Pairs of a document with many partners are split by the adaptive
    execution like any skewed join key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        last: tuple[bytes, np.ndarray] | None = None
        for batch in batches:
            left, right = byte_column(batch.column(2)), byte_column(batch.column(3))
            both, either = [], []
            for x, y in zip(left, right, strict=True):
                if last is None or last[0] != x:
                    last = (x, shingle_sets([x], table)[0])
                other = shingle_sets([y], table)[0]
                n = len(np.intersect1d(last[1], other, assume_unique=True))
                both.append(n)
                either.append(len(last[1]) + len(other) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"])

    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a bigint, b bigint, both bigint, either bigint")


def shingle_rows(texts: DataFrame) -> DataFrame:
    """(rep, shingle): the full sets of ``texts`` (id, text), a row per shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            ids, data = batch.column(0).to_numpy(zero_copy_only=False), byte_column(batch.column(1))
            for lo, hi in slices([len(x) for x in data]):
                sets = shingle_sets(data[lo:hi], table)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo:hi], [len(s) for s in sets]).astype(np.int64)), pa.array(np.concatenate(sets).view(np.int64))], names=["rep", "shingle"])

    return texts.select("id", "text").mapInArrow(run, "rep bigint, shingle bigint")


def remaining_pairs(left: DataFrame, bands: DataFrame, texts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb): pairs of ``left`` (key, rep, component, far) in different components that may be links.

    ``bands`` has (rep, bands), ``texts`` (id, text), ``nodes`` the sketch table.

    Shingles that at most ``RARE`` documents of ``left`` have are rare, the others common. A pair's overlap
    is at most the smaller number of common shingles, plus the rare ones that both have. So a link either
    shares a rare shingle, and is found by an index of these with at most ``RARE`` entries a shingle, or
    is found among bucket mates whose common shingles alone suffice. Both bounds are exact.
    """
    ids = staged(left.select("rep", "component").distinct(), "left-ids")
    rows = staged(shingle_rows(texts.join(ids.select(F.col("rep").alias("id")), "id", "left_semi")), "rows")
    rare = staged(rows.join(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= RARE), "shingle"), "rare")
    sizes = nodes.groupBy(F.col("doc_id").alias("rep")).agg(F.min("n_shingles").alias("size"), F.max("digest").alias("last"), F.min("digest").alias("first"))
    # an id with several texts has no single size, so all its shingles count as common
    common = F.when(F.col("first") == F.col("last"), F.col("size") - F.coalesce("few", F.lit(0))).otherwise(F.col("size"))
    spread = sizes.join(ids, "rep").join(rare.groupBy("rep").agg(F.count(F.lit(1)).alias("few")), "rep", "left")
    spread = staged(spread.select("rep", "component", "size", common.alias("common")), "spread")
    other = spread.select(*[F.col(c).alias(f"{c}2") for c in spread.columns])

    def enough(overlap: Column) -> Column:
        return overlap * 100 >= (F.col("size") + F.col("size2") - overlap) * percent

    least = F.least("common", "common2")
    mates = left.select("key", "rep", "far").join(spread.where(F.col("common") * 100 >= F.col("size") * percent), "rep").join(bands, "rep")
    # members of a bucket's largest component need not meet each other; large buckets are dealt over parts
    counted = mates.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"))
    largest = staged(counted.select("key", "largest", "n", (F.col("n") / BUCKET_ROWS).cast("int").alias("more")), "largest")
    total = largest.agg(F.sum("n")).first()[0] or 0
    mates = staged(spread_join(mates, largest.drop("n"), "key", "rep", largest, total), "mates")
    minor = mates.where("component <> largest").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("more") + 1).cast("int")).drop("more")
    mates2 = mates.select("key", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("part"), *[F.col(c).alias(f"{c}2") for c in ("rep", "component", "size", "common", "far", "bands")])
    reach = 1 - percent / 100 + 1e-9
    apart = (F.col("component") != F.col("component2")) & ((F.col("component2") == F.col("largest")) | (F.col("rep") < F.col("rep2")))
    once = F.array_min(F.array_intersect("bands", "bands2")) == F.col("key")  # a pair counts in one of its buckets
    near = minor.join(mates2, ["key", "part"]).where(apart & enough(least) & (F.abs(F.col("far") - F.col("far2")) <= reach) & once)
    few = rare.where("n > 1").select("shingle", "rep")
    shared = few.join(few.withColumnRenamed("rep", "rep2"), "shingle").where("rep < rep2").groupBy("rep", "rep2").agg(F.count(F.lit(1)).alias("both"))
    met = shared.join(spread, "rep").join(other, "rep2").where((F.col("component") != F.col("component2")) & enough(least + F.col("both")))
    columns = [F.col("rep").alias("a"), F.col("rep2").alias("b"), F.col("component").alias("ca"), F.col("component2").alias("cb")]
    return near.select(columns).union(met.select(columns)).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``links`` (a, b), for every id that has a link.

    Contraction: in each round a node goes to the first of its neighbours and itself, in the order of the ids
    in the first round, which settles stars around their smallest id, and of a hash of the round after
    that. Nodes that went to the same one become one node. A share of the nodes of any graph goes in each such
    round whatever the order of the ids, so the rounds grow with the logarithm of the nodes, and the edges that
    are left shrink. Each round is a staged table; the way back joins from the last round to the first.
    """
    edges = staged(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")).where("src <> dst").distinct(), "edges")
    rounds: list[tuple[DataFrame, int]] = []
    while edges.limit(1).count():
        order = (lambda x: F.col(x)) if not rounds else (lambda x, r=len(rounds): F.xxhash64(F.lit(r), F.col(x)))
        first = edges.withColumn("order", order("dst")).groupBy("src").agg(F.min("order").alias("order"), F.min_by("dst", "order").alias("near"), F.count(F.lit(1)).alias("n"))
        up = staged(first.select(F.col("src").alias("node"), F.when(order("src") <= F.col("order"), F.col("src")).otherwise(F.col("near")).alias("up"), "n"), "up")
        total = up.agg(F.sum("n")).first()[0]
        rounds.append((up, total))
        one = spread_join(edges.withColumnRenamed("src", "node"), up.select("node", F.col("up").alias("src")), "node", "dst", up, total).select("src", F.col("dst").alias("node"))
        two = spread_join(one, up.select("node", F.col("up").alias("dst")), "node", "src", up, total).select("src", "dst")
        edges = staged(two.where("src <> dst").distinct(), "edges")
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    found = None
    for up, _ in reversed(rounds):
        if found is None:
            found = up.select("node", F.col("up").alias("top"))
        else:
            counted = up.groupBy("up").agg(F.count(F.lit(1)).alias("n"))
            higher = spread_join(up.select("node", "up"), found.select(F.col("node").alias("up"), "top"), "up", "node", counted, up.count(), "left")
            found = staged(higher.select("node", F.coalesce("top", "up").alias("top")), "tops")
    least = staged(found.groupBy("top").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")), "least")
    return staged(spread_join(found, least.drop("n"), "top", "node", least, found.count()).select(F.col("node").alias("id"), "component"), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are runs of characters other than 0x20 and 0x09 to 0x0D, with A to Z lower-cased; the set of
    a text is its distinct 5-word shingles, the whole sequence when it has fewer words. Documents are
    linked when 100 * intersection >= ``percent`` * union. Null and empty texts, and those without a
    word, have an empty set and no link. Rows that repeat an id count as one document with the links
    of each of its texts. A null id can join a component but never names one. Ties do not arise, as ids
    decide. Very long texts are taken whole. Sets hold 64-bit hashes of shingles, so sizes and links are exact but for
    collisions of these. Other columns are ignored; an empty table gives an empty result.
    """
    nodes_all = staged(sketch_table(docs, id_col, text_col), "sketches")
    classes = staged(nodes_all.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("rep is not null"), "classes")
    one = classes.select("digest", F.col("rep").alias("doc_id"))
    nodes = staged(nodes_all.select("digest", "doc_id", "bands").join(one, ["digest", "doc_id"]).select(F.col("doc_id").alias("rep"), "bands").distinct(), "nodes")
    rows = nodes.select("rep", F.explode("bands").alias("key"))
    leaders = staged(rows.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n")).where("leader < last").drop("last"), "leaders")
    shared = leaders.agg(F.sum("n")).first()[0] or 0
    members = staged(spread_join(rows, leaders.drop("n"), "key", "rep", leaders, shared), "members")

    star = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    involved = members.select(F.col("rep").alias("id")).distinct()
    texts = staged(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(involved, "id", "left_semi"), "texts")
    checked = staged(overlaps(star, texts), "checked")
    is_link = F.col("both") * 100 >= F.col("either") * percent
    found = components(checked.where(is_link).select("a", "b"))

    named = found.withColumnRenamed("id", "rep")
    placed = members.where("rep <> leader").join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = staged(placed, "placed")
    split = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    far = checked.select(F.col("a").alias("leader"), F.col("b").alias("rep"), (1 - F.col("both") / F.col("either")).alias("far"))
    left = staged(spread_join(placed, split, "key", "rep", leaders, shared, "left_semi").join(far, ["leader", "rep"]).select("key", "rep", "component", "far"), "left")
    pairs = staged(remaining_pairs(left, nodes.groupBy("rep").agg(F.flatten(F.collect_list("bands")).alias("bands")), texts, nodes_all, percent), "pairs")
    later = overlaps(pairs.select("a", "b"), texts).where(is_link).select("a", "b")
    joins = staged(later.join(pairs, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "joins")
    if joins.limit(1).count():
        higher = components(joins).select(F.col("id").alias("component"), F.col("component").alias("top"))
        alone = joins.select(F.col("a").alias("id")).union(joins.select("b")).distinct().join(found, "id", "left_anti").select("id", F.col("id").alias("component"))
        found = found.unionByName(alone).join(higher, "component", "left").select("id", F.coalesce("top", "component").alias("component"))

    component = staged(classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id")), "components")
    with_set = nodes_all.where("digest is not null").select("doc_id", "n_shingles", "digest")
    full = spread_join(with_set, component, "digest", "doc_id", classes, with_set.count(), "left").drop("digest")
    bare = nodes_all.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.unionByName(bare)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document stays: one of each component, all its columns.

    Rows that go are marked by their id, so rows with a null id stay, as do all rows that repeat a kept id.
    """
    found = near_duplicates(docs, id_col, text_col, percent)
    gone = staged(found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("kept").alias("kept")).where("not kept").select(id_col), "near-gone")
    return docs.join(gone.hint("shuffle_hash"), id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
                      WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c FROM e l JOIN e r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * c >= 75 * (len(sa.sh) + len(sb.sh) - c)),
u AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS id, doc_id AS reach FROM s UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reach)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN (SELECT id, min(reach) AS component_id FROM r GROUP BY id) ON id = doc_id
"""
