"""A corpus pipeline: language identification, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each result as
Parquet into the shared folder and reads it again as the next stage's documents.

In every stage null ids and repeated ids are rows like others, extra columns are carried along whatever their
names, very long texts are taken whole, and an empty table gives an empty result. Null texts, empty texts and
texts without a letter go in the first stage. Of equal texts the longest original stays (ties: the smallest id;
rows that repeat both: one of them), of near-duplicates the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, language_id, mixing, near_dedup, packing
from tidemark.llm.common import documents, staged
from tidemark.session import ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can be told; null texts and texts without a letter go (with no label to learn from, these alone)."""
    ship_package(spark)
    return language_id.reject_unidentified(docs, language_id.learn(docs.where(~language_id.held_out())))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest original of each group of equal texts."""
    ship_package(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates; rows with a null id stay."""
    ship_package(spark)
    return near_dedup.drop_near_copies(docs)


#: Words that a worker remembers while it packs; fewer than op8 by itself, as the stages before have grown the executor.
PACKING_WORDS = 150_000
#: What the toxic domain keeps of its tokens; the other domains keep all of theirs.
TOXIC_SHARE = 0.1


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their fitted rate, which is 1 at most: toxic ones are thinned, the others stay, and none is doubled."""
    import public_tokenizers

    ship_package(spark)
    return mixing.mixed(docs, mixing.domain_labels(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), mixing.thinned("toxic", TOXIC_SHARE), cap=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in training sequences."""
    import public_tokenizers

    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cache_entries=PACKING_WORDS)


STAGES = [
    ("language id", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("packing", pack),
]

#: Profiles, classifier and packing have no SQL form; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
