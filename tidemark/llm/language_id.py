"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams of a language in order. A document's own list is
compared to each profile by the out-of-place distance: the sum of rank differences, with the list
length for n-grams that a profile lacks. Profiles are a few hundred ranks a language, learned from a
bounded sample of labelled rows; every document is ranked over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents

#: N-grams in a profile, and in a document's list.
RANKS = 300
#: Letters and gaps that n-grams are counted over at a time, which bounds the memory that a long text takes.
STRETCH = 1 << 20
#: Labelled rows a language that profiles are learned from (expected number; a hash of the id chooses).
TRAIN_ROWS = 400
UNKNOWN = "und"
_GAP = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to itself for letters, else to the gap."""
    table = np.full(0x110000, _GAP, dtype=np.int32)
    points = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()], dtype=np.int32)
    table[points] = points
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the lower-cased letters, packed 21 bits a character, and how often each occurs.

    Runs of other characters are one gap; n-grams of gaps alone do not count. Empty where no letter is.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = _letters()[points]
    letter = code != _GAP
    if not letter.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    code = np.concatenate((np.array([_GAP], dtype=np.int32), code, np.array([_GAP], dtype=np.int32)))
    code = code[np.concatenate(([True], (code[1:] != _GAP) | (code[:-1] != _GAP)))]
    found = [_counted(code[lo : lo + STRETCH + 2].astype(np.int64), STRETCH) for lo in range(0, len(code), STRETCH)]
    if len(found) == 1:
        return found[0]
    keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def _counted(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that begin among the first ``size`` characters, and how often each occurs."""
    two = code[:-1] | (code[1:] << 21)
    three = two[:-1] | (code[2:] << 42)
    keys = np.sort(np.concatenate((code[:size][code[:size] != _GAP], two[:size], three[:size])))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def ranked(keys: np.ndarray, counts: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent keys first, ties by key."""
    return keys[np.argsort(-counts, kind="stable")[:ranks]]


class Profiles:
    """Profiles of several languages as one sorted key list and a rank matrix."""

    def __init__(self, lists: dict[str, np.ndarray], ranks: int = RANKS):
        self.names, self.ranks = sorted(lists), ranks
        self.keys = np.unique(np.concatenate([lists[x] for x in self.names])) if lists else np.zeros(0, dtype=np.int64)
        self.place = np.full((len(self.names), len(self.keys) + 1), -1, dtype=np.int64)
        for i, name in enumerate(self.names):
            self.place[i, np.searchsorted(self.keys, lists[name])] = np.arange(len(lists[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least distance (ties: first name) and 1 - distance / largest possible distance."""
        if text is None or not self.names:
            return UNKNOWN, 0.0
        own = ranked(*grams(text), self.ranks)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        place = self.place[:, at]
        far = np.where(place < 0, self.ranks, np.abs(place - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(far))
        return self.names[best], float(1 - far[best] / (self.ranks * len(own)))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_rows: int = TRAIN_ROWS, ranks: int = RANKS) -> Profiles:
    """Profiles of the labels in ``docs``, from about ``train_rows`` rows a label that a hash of the id chooses.

    All labels are learned; a label costs the driver its number of rows and its ``ranks`` n-grams.
    """
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}
    if not sizes:
        return Profiles({}, ranks)
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, train_rows / n))])
    unit = (F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    chosen = rows.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), unit.alias("unit")).where(F.col("unit") < F.try_element_at(share, F.col("label")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels: list[str] = []
            keys: list[np.ndarray] = []
            counts: list[np.ndarray] = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, n = grams(text)
                labels += [label] * len(k)
                keys.append(k)
                counts.append(n)
            if labels:
                yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], names=["label", "gram", "n"])

    counted = chosen.select("label", "text").mapInArrow(count, "label string, gram bigint, n bigint")
    by = Window.partitionBy("label").orderBy(F.desc("n"), "gram")
    top = counted.groupBy("label", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= ranks)
    lists: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("label", "rank", "gram").collect():
        lists.setdefault(r["label"], []).append((r["rank"], r["gram"]))
    return Profiles({k: np.array([g for _, g in sorted(v)], dtype=np.int64) for k, v in lists.items()}, ranks)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (0 to 1). Null texts, and those without a letter, are ``und`` with score 0.

    So is every text where nothing was learned (an empty table, or no label). Of languages at the same
    distance the first name wins. Very long texts are ranked whole. Repeated rows are answered each; other
    columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [profiles.predict(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` bigint, lang_pred string, score double")


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def reject_unidentified(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language can be told; those that are ``und`` go.

    Where nothing was learned, only null texts and texts without a letter go. Ids play no part, so rows with a
    null or a repeated id are kept like others.
    """
    fields = [f.name for f in docs.schema.fields]

    def known(text: str | None) -> bool:
        if profiles.names:
            return profiles.predict(text)[0] != UNKNOWN
        return any(c.isalpha() for c in text or "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([known(x) for x in batch.column(fields.index(text_col)).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
