"""Token counts by a map-side two-tier lookup.

A text is cut where the tokenizer itself can never merge: before every run of spaces. The count of a
text is the sum over its pre-tokens. Tier one is a broadcast table of the frequent pre-tokens and
their lengths, of a fixed number of entries; tier two is a cache in each Python worker that the
tokenizer fills on a miss. No pre-token is shuffled: each input partition only sends a summary of at
most ``local_top`` of its most frequent pre-tokens, from which the broadcast table is chosen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_column, documents

#: U+2581, which the tokenizer writes for a space.
MARK = "▁".encode()
_RUN = re.compile(rb" *[^ ]+| +")
#: Longer pre-tokens are encoded each time, so that a cache entry has a bounded size.
LONGEST_CACHED = 64
CACHE_ENTRIES = 600_000
#: Counters inside the summary pass are pruned to half of this many entries.
SUMMARY_ENTRIES = 400_000


def pre_tokens(text: bytes) -> list[bytes]:
    """The pre-tokens of a text, each without its leading mark (the tokenizer adds one to whatever it encodes)."""
    if MARK in text:
        text = text.replace(MARK, b" ")
    if b"  " not in text and not text.startswith(b" ") and not text.endswith(b" "):
        return text.split(b" ") if text else []
    return [x[1:] for x in _RUN.findall(b" " + text)]


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    bad = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if re.search("[^▁]▁", p)]
    if bad:
        raise ValueError(f"pieces span pre-tokens: {bad[:3]}")
    for text in ("a", " a  b ", "ﬁ Ａ½", "e\u0301 \u212b"):  # a mark is put before a text, blanks are kept, and no character is replaced
        got = "".join(model.encode(text, out_type=str))
        if re.sub("<0x..>", "", got) != re.sub("<0x..>", "", "▁" + text.replace(" ", "▁")) and "<0x" not in got:
            raise ValueError(f"the model normalises texts: {text!r} becomes {got!r}")
    return model


class LengthTable(dict):
    """Pre-token to token count; a miss is encoded and, within the bound, remembered."""

    def __init__(self, path: str, frequent: dict[bytes, int]):
        super().__init__(frequent)
        self.encode, self.frequent = _processor(path).encode, frequent
        self[b""] = 1  # the mark alone

    def __missing__(self, key: bytes) -> int:
        n = len(self.encode(key.decode("utf-8")))
        if len(key) <= LONGEST_CACHED:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
                self.update(self.frequent)
                self[b""] = 1
            self[key] = n
        return n

    def count(self, text: bytes) -> int:
        return sum(map(self.__getitem__, pre_tokens(text)))


def frequent_pre_tokens(docs: DataFrame, text_col: str = "text", size: int = 1 << 15, local_top: int = 4096) -> list[bytes]:
    """At most ``size`` pre-tokens that are frequent over all of ``docs``, from a summary of each partition."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in byte_column(batch.column(0)):
                seen.update(x for x in pre_tokens(text) if len(x) <= LONGEST_CACHED) if len(text) > 1 << 16 else seen.update(pre_tokens(text))
                if len(seen) > SUMMARY_ENTRIES:
                    seen = Counter(dict(seen.most_common(SUMMARY_ENTRIES // 2)))
        top = [x for x in seen.most_common(local_top) if len(x[0]) <= LONGEST_CACHED]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in top], pa.binary()), pa.array([x[1] for x in top], pa.int64())], names=["token", "n"])

    tops = docs.select(text_col).mapInArrow(summary, "token binary, n bigint")
    total = tops.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(size)
    return [bytes(r.token) for r in total.select("token").collect()]


@lru_cache(maxsize=1)
def _length_table(path: str, keys: tuple[bytes, ...], lengths: bytes) -> LengthTable:
    """The table of this worker: its tasks share it."""
    return LengthTable(path, dict(zip(keys, lengths, strict=True)))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, table_size: int = 1 << 15, local_top: int = 4096) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the sentencepiece model for the whole text, without begin or end tokens. Null
    and empty texts have 0 bytes and 0 tokens. Very long texts are counted whole. Repeated rows are counted
    each; other columns, whatever their names, are ignored. An empty table gives an empty result. Ties in
    frequency decide only which pre-tokens are broadcast, not the counts.
    """
    keys = frequent_pre_tokens(docs, text_col, table_size, local_top)
    encode = _processor(model_path).encode
    lengths = np.array([len(encode(k.decode("utf-8"))) if k else 1 for k in keys], dtype=np.uint8)
    packed = docs.sparkSession.sparkContext.broadcast((tuple(keys), lengths.tobytes()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _length_table(model_path, *packed.value)
        for batch in batches:
            texts = byte_column(batch.column(1))
            n = [table.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(count, f"`{id_col}` bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
