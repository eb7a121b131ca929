"""Exact deduplication: local combine, salted merge, global combine of the salt winners.

Digests are counted first, which moves 32 bytes a row. A digest that occurs once stands for a text without
a copy. Only rows whose digest occurs twice or more go through the three stages, and every stage groups on
the digest *and* the whole normalised text, so equal digests of different texts never meet.

A frequent digest is dealt over salts wherever rows meet by it, so that no task gets all copies of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, staged, text_or_empty

#: The characters that do not count: 0x20 and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
_WIDE = "decimal(38,0)"
#: Parts that the rows of a digest are dealt over, and rows of a group that meet in one task on the way back.
SALTS, SHARE = 32, 512


def normalised(text_col: str = "text"):
    return F.translate(text_or_empty(text_col), BLANKS, "")


def _rank(id_col: str, text_col: str) -> Column:
    """One ordered number for (an id at all, most code points, then smallest id): it lets an aggregate keep a winner in place."""
    two64, two96 = F.lit("18446744073709551616").cast(_WIDE), F.lit("79228162514264337593543950336").cast(_WIDE)
    long = F.length(text_or_empty(text_col)).cast(_WIDE) * two64
    return F.coalesce(long + (F.lit("9223372036854775807").cast(_WIDE) - F.col(id_col).cast("long").cast(_WIDE)), long - two96)


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def repeated_digests(docs: DataFrame, text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(digest, salt) of each digest that occurs more than once, for each salt; a staged table."""
    rows = docs.select(_digest(normalised(text_col)).alias("digest"), (F.spark_partition_id() % salts).alias("salt"))
    counted = rows.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.sum("n").alias("n"))
    return staged(counted.where("n > 1").select("digest"), "repeated").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _salt(id_col: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)) + F.spark_partition_id(), F.lit(salts)).cast("int")


def combined(rows: DataFrame, winner: Column) -> DataFrame:
    """(digest, norm, rank, copies, best): ``best`` is ``winner`` of the row of largest rank. ``rows`` has digest, norm, salt, rank.

    1. *local*: the map side of the first aggregate keeps one row for each text and salt of its partition;
    2. *salted*: those meet by (digest, text, salt);
    3. *global*: the winners of a text's salts meet, one for each salt.
    """
    merged = rows.groupBy("digest", "norm", "salt").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("copies"), F.max_by(winner, "rank").alias("best"))
    return merged.groupBy("digest", "norm").agg(F.max("rank").alias("rank"), F.sum("copies").alias("copies"), F.max_by("best", "rank").alias("best"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after deleting the characters of ``BLANKS``; the longest original
    text (code points), then the smallest id stays. Null text counts as empty; empty texts form one
    group. A null id never wins over another id and is never kept. Rows that repeat an id and a text are
    both marked kept. Very long texts are compared whole. Other columns, whatever their names, are
    ignored; an empty table gives an empty result.
    """
    repeated = repeated_digests(docs, text_col, salts)
    norm = normalised(text_col)
    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(norm).alias("digest"), _salt(id_col, salts).alias("salt"))
    alone = bare.join(repeated.hint("shuffle_hash"), ["digest", "salt"], "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"), _rank(id_col, text_col).alias("rank"), _digest(norm).alias("digest"), _salt(id_col, salts).alias("salt"))
    copies = staged(rows.join(repeated.hint("shuffle_hash"), ["digest", "salt"], "left_semi"), "copies")
    groups = staged(combined(copies, F.col("doc_id")), "dedup-groups")
    # a group is there once for each SHARE of its rows, so that the way back does not meet in one task either
    parts = (F.col("copies") / F.lit(SHARE)).cast("int") + 1
    sized = groups.groupBy("digest").agg(F.max(parts).alias("parts"))
    dealt = copies.join(sized.where("parts > 1"), "digest", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "salt") + F.spark_partition_id(), F.coalesce("parts", F.lit(1))).cast("int"))
    targets = groups.join(sized, "digest").select("digest", "norm", F.col("best").alias("keep_id"), F.col("copies").alias("group_size"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = dealt.select("digest", "norm", "part", "doc_id").join(targets, ["digest", "norm", "part"]).select("doc_id", "keep_id", "group_size", "digest")

    both = alone.unionByName(found)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return both.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of each group of equal texts, with all its columns: the one that :func:`exact_dedup` keeps.

    Of rows that repeat both the id and the length, one stays. A text that occurs with null ids alone stays
    once. Null and empty texts are one group. Columns keep their names and order, whatever these are.
    """
    repeated = repeated_digests(docs, text_col, salts)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    norm = normalised(text_col)
    rows = docs.select(row.alias("row"), _digest(norm).alias("digest"), _salt(id_col, salts).alias("salt")).where("digest is not null and salt is not null")
    # both sides take the same columns from ``rows``, so that they read one shuffle
    alone = rows.join(repeated.hint("shuffle_hash"), ["digest", "salt"], "left_anti").select("row")
    copies = rows.join(repeated.hint("shuffle_hash"), ["digest", "salt"], "left_semi")
    copies = copies.select("*", normalised(f"row.`{text_col}`").alias("norm"), _rank(f"row.`{id_col}`", f"row.`{text_col}`").alias("rank"))
    best = combined(copies, F.col("row")).select(F.col("best").alias("row"))
    return alone.unionByName(best).select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
w AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
