"""Sharding by proportional stratified interleaving: every shard has the mixture of the whole.

Rows of a source are put in a seeded random order. The row of rank r among n of its source stands at the
fraction (r + u) / n of the whole, where u in [0, 1) is drawn for the source, so that small sources do not all meet
in the middle. Sorted by these fractions, any stretch of rows has each source in proportion, and equal stretches
are the shards: their counts differ by one at most.

Nothing but DataFrame functions is used. Ranks need no window over a whole source: rows fall into buckets by the
leading bits of their digest, which are uniform, the counts of the buckets of a source are summed up, and only
rows of one bucket are sorted together. The same is done with buckets of the fraction for the order of all. Copies,
rows that agree in id, source and text, are counted before and dealt out again after the first sort, so that no
bucket has more of them than of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, staged, text_or_empty

SHARDS = 40
SEED = "interleave-1"
#: Buckets of a source's digests and buckets of the fractions: fixed, so that both lists of counts stay bounded.
DIGEST_BUCKETS, FRACTION_BUCKETS = 4096, 5120
#: Copies of a row that are dealt out together.
_COPIES = 1024
#: Bytes that a row counts beside its text.
ROW_BYTES = 16

_KEY = ["stratum", "id", "text_crc32", "size"]


def _stratum(source: Column) -> Column:
    """A source as a string that is never null: no source is one of its own, and not the empty one."""
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("none"))


def _shown(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def _described(id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = text_or_empty(text_col)
    found = [_stratum(F.col(source_col)), F.col(id_col).cast("long"), F.crc32(text.cast("binary")), F.octet_length(text).cast("long") + ROW_BYTES]
    return [c.alias(n) for c, n in zip(found, _KEY, strict=True)]


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(stratum, id, text_crc32, size) of each row: all that the placement looks at."""
    return docs.select(*_described(id_col, text_col, source_col))


def _started(counts: DataFrame, window, n: str = "n") -> DataFrame:
    """``counts`` with the sum of ``n`` over the rows before, as ``start``."""
    return counts.withColumn("start", F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def interleaved(rows: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Rows of :func:`described` with ``copy`` (from 0 among equal ones), ``position`` in the order of all, ``shard`` and ``slot`` in the shard.

    A null id is a value like any other; rows that agree in all four columns are copies, which get places of
    their own, and of the places of one key it does not matter which row takes which. Ties of fractions go by
    source and rank. An empty table gives an empty result.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(seed), _shown("id"), F.col("text_crc32").cast("string"), F.col("size").cast("string")), 256)
    bucket = (F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") / F.lit(1 << 32) * DIGEST_BUCKETS).cast("int")
    keys = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", digest).withColumn("bucket", bucket)

    # rank within the source: what lies in the buckets before, and what lies before in the own one
    per_bucket = staged(keys.groupBy("stratum", "bucket").agg(F.sum("copies").alias("n")), "digest-buckets")
    of_source = Window.partitionBy("stratum")
    starts = _started(per_bucket, of_source.orderBy("bucket")).withColumn("of", F.sum("n").over(of_source)).drop("n")
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("stratum")), 256), 1, 8), 16, 10).cast("long") / F.lit(1 << 32)
    own = Window.partitionBy("stratum", "bucket").orderBy("digest", *_KEY[1:]).rowsBetween(Window.unboundedPreceding, -1)
    ranked = keys.withColumn("before", F.coalesce(F.sum("copies").over(own), F.lit(0))).join(starts, ["stratum", "bucket"])
    ranked = ranked.select(*_KEY, "copies", "of", (F.col("start") + F.col("before")).alias("first"))
    chunks = ranked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(_COPIES).cast("long"))).alias("chunk"))
    each = chunks.select("*", F.explode(F.sequence(F.col("chunk"), F.least(F.col("chunk") + _COPIES, F.col("copies")) - 1)).alias("copy"))
    rank = F.col("first") + F.col("copy")
    placed = each.select(*_KEY, "copy", rank.alias("rank"), ((rank + draw) / F.col("of")).alias("fraction"))
    placed = staged(placed.withColumn("cut", F.least(F.lit(FRACTION_BUCKETS - 1), (F.col("fraction") * FRACTION_BUCKETS).cast("int"))), "fractions")

    # place in the order of all, likewise; there are FRACTION_BUCKETS counts whatever the number of rows
    cuts = placed.groupBy("cut").agg(F.count(F.lit(1)).alias("n"))
    everywhere = Window.partitionBy(F.lit(0))
    cuts = F.broadcast(_started(cuts, everywhere.orderBy("cut")).withColumn("total", F.sum("n").over(everywhere)).drop("n"))
    within = Window.partitionBy("cut").orderBy("fraction", "stratum", "rank")
    spot = placed.withColumn("nth", F.row_number().over(within) - 1).join(cuts, "cut").withColumn("position", F.col("start") + F.col("nth"))
    shard = F.floor(F.col("position") * shards / F.col("total"))  # exact where positions times shards stay below 2 ** 53
    slot = F.col("position") - F.ceil(F.col("shard") * F.col("total") / shards)
    return spot.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).select(*_KEY, "copy", "position", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Write the rows of ``docs``, all columns, to ``path``/_shard=.../ and return them with ``_shard`` and ``_slot``.

    The files of a shard hold its rows in the order of ``_slot``. Copies are numbered within the partition that
    they are read from, and these numbers are carried on from partition to partition, so that many copies of a row
    do not meet in one task. Rows are whole whatever their length; an empty table writes no shard.
    """
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line"))
    marked = staged(marked, "rows-to-shard")
    rows = staged(marked.select("part", "line", *_described(f"row.`{id_col}`", f"row.`{text_col}`", f"row.`{source_col}`")), "described")
    keyed = rows.withColumn("id", _shown("id"))
    counts = keyed.groupBy(*_KEY, "part").agg(F.count(F.lit(1)).alias("n"))
    starts = _started(counts, Window.partitionBy(*_KEY).orderBy("part")).drop("n")
    nth = F.row_number().over(Window.partitionBy(*_KEY, "part").orderBy("line"))
    numbered = keyed.withColumn("nth", nth).join(starts, [*_KEY, "part"]).withColumn("copy", F.col("start") + F.col("nth"))
    places = interleaved(rows, shards, seed).withColumn("id", _shown("id")).withColumn("copy", F.col("copy") + 1)
    placed = numbered.join(places, [*_KEY, "copy"]).select("line", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    whole = marked.join(placed, "line").select("row.*", "_shard", "_slot")
    whole.repartition(shards, "_shard").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
    return docs.sparkSession.read.schema(whole.schema).parquet(path)


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(described(documents(spark, sf_dir)), "described")
    law = F.lit("rows").alias("law")
    return interleaved(rows).select(F.col("id").alias("doc_id"), "size", "text_crc32", law, "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "position")


def _sql(shards: int = SHARDS, seed: str = SEED) -> str:
    """The same order by windows over whole sources; the checksum goes byte by byte through the table of its polynomial."""
    return f"""
WITH crc AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(n))),
d AS (
  SELECT doc_id, coalesce('s:' || source, 'none') AS stratum, strlen(coalesce(text, '')) + {ROW_BYTES} AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST(('0x' || h) AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
  FROM documents, crc),
r AS (
  SELECT *, count(*) OVER (PARTITION BY stratum) AS n, CAST(('0x' || substr(sha256('{seed}:' || stratum), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS draw,
         row_number() OVER (PARTITION BY stratum ORDER BY sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_crc32 || ':' || size)) - 1 AS rank
  FROM d),
p AS (
  SELECT *, row_number() OVER (ORDER BY (rank + draw) / n, stratum, rank) - 1 AS position, count(*) OVER () AS total FROM r),
s AS (SELECT *, CAST(floor(position * {shards} / CAST(total AS DOUBLE)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, position - CAST(ceil(shard * total / CAST({shards} AS DOUBLE)) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, position
FROM s"""


OP13_SQL = _sql()
