"""Packing of documents into sequences by Karmarkar-Karp multiway differencing.

Tokenising and cutting need no shuffle: a document's cut positions follow from its token count alone,
so the checksum of every piece is taken where its ids are made, and only piece descriptors move on.
Full windows stand alone. The rest is dealt into groups of bounded size; within a group, partial
partitions are merged largest spread first, so that large windows of one meet small windows of the
other, which leaves windows of near-equal sums. Where a window exceeds the capacity, the group is
packed anew with more windows.
"""

from __future__ import annotations

import heapq
import math
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_column, documents, looked_up, staged, worker_table

CAPACITY = 4096
#: Pieces that are not full windows are at most this long, so that near-equal windows are within reach.
LONGEST_PIECE = 1024
#: Windows that a group aims at.
GROUP_WINDOWS = 192
#: Pieces below the first are bundled to about the second before the differencing; 32 bundles are a window.
SMALL_PIECE, BUNDLE = 32, 128
CACHE_ENTRIES = 1_200_000
#: ASCII marks that the tokenizer takes as one run after a word; not the apostrophe, nor what special strings are written with.
_MARKS = b".,;:!?*#$&%()+=~"


def _plain(core: bytes) -> bool:
    """Whether a word of letters keeps a letter as its last character, composed and lower-cased as the tokenizer does.

    Else, as with a capital I with a dot, it ends in a mark, which the tokenizer takes together with the marks after it.
    """
    word = core.decode("utf-8")
    return word.isalpha() and unicodedata.normalize("NFC", word)[-1].lower()[-1].isalpha()


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, and which of its ids end a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to other tasks
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    ends = np.zeros(made.get_vocab_size(), dtype=bool)
    ends[[i for x, i in made.get_vocab().items() if x.endswith("</w>")]] = True
    return made, ends


class WordIds(dict):
    """White-space separated word to its ids, as little-endian unsigned 32-bit bytes.

    A word of letters, lower-cased, with or without marks after it, is looked up in two parts. New parts are
    encoded as one text, whose ids are cut after each word end; should that not give one cut a part,
    or where a word has another form, words are encoded one by one.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.entries = entries
        self.tokenizer, self.ends = _tokenizer(path)
        self.parts: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> bool:
        """Make sure that the table has all of ``words``; whether others had to go for that."""
        new = {x for x in words if x not in self}  # set.difference would go through the whole table
        if full := len(self) + len(new) > self.entries:
            self.clear()
            self.parts.clear()
            new = words
        cores, tails, plain, odd = [], [], [], []
        for word in new:
            core = word.rstrip(_MARKS)
            if core.isalpha() or _plain(core):
                plain.append(word)
                cores.append(core.lower())
                tails.append(word[len(core) :])
            else:
                odd.append(word)
        parts = self.parts
        self._learn_parts(list(set(cores).union(filter(None, tails)).difference(parts)))
        self.update(zip(plain, [parts[c] + parts[t] if t else parts[c] for c, t in zip(cores, tails, strict=True)], strict=True))
        self.update(zip(odd, self._one_by_one(odd), strict=True))
        return full

    def _learn_parts(self, new: list[bytes]) -> None:
        for lo in range(0, len(new), 4096):
            own = new[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(own).decode("utf-8")], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(own) and cut[-1] == len(ids):
                data, at = ids.tobytes(), [0, *(4 * cut).tolist()]
                self.parts.update((x, data[i:j]) for x, i, j in zip(own, at, at[1:], strict=False))
            else:
                self.parts.update(zip(own, self._one_by_one(own), strict=True))

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False) if words else []
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]


def encoded(texts: list[bytes], table: WordIds, end: bytes) -> Iterator[bytes]:
    """The ids of each text, with ``end`` after them, as bytes."""
    for ids in looked_up(texts, table, bytes.split):
        yield b"".join(ids) + end


def cuts(n: int, capacity: int = CAPACITY, longest: int = LONGEST_PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with ``n`` ids: full windows, then the rest in near-equal parts."""
    full = n // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    rest, at = n - full * capacity, full * capacity
    if rest:
        parts = -(-rest // longest)
        for i in range(parts):
            size = rest // parts + (i < rest % parts)
            out.append((at, size))
            at += size
    return out


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(WordIds, tokenizer_path, cache_entries)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), byte_column(batch.column(1))
            rows: list[tuple] = []
            for doc, data in zip(ids, encoded(texts, table, end), strict=True):
                n, view = len(data) // 4, memoryview(data)
                rows += [(doc, s, k, zlib.crc32(view[4 * s : 4 * (s + k)]), n) for s, k in cuts(n, capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def difference(sizes: np.ndarray, windows: int) -> list[np.ndarray]:
    """Karmarkar-Karp: indices of ``sizes`` in ``windows`` sets of near-equal sums.

    Each item starts as a partial partition of its own: its size in one window, the others empty. A
    partial partition keeps its occupied windows only, sums in falling order, and a node for each. The two
    with the largest spreads are merged, the largest windows of one with the smallest of the other (empty
    ones first), until one is left. Two windows that meet become a node with two children.
    """
    n = len(sizes)
    if not n:
        return []
    one = lambda x: np.array([x], dtype=np.int64)
    heap = [(-int(x) if windows > 1 else 0, i, one(x), one(i)) for i, x in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    children: list[np.ndarray] = []
    serial = nodes = n
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        met = max(0, len(a) + len(b) - windows)
        # the smallest ``met`` windows of each side have no empty window to go to
        i, j = len(a) - met, len(b) - met
        sums = np.concatenate((a[:i], b[:j], a[i:] + b[j:][::-1]))
        pairs = np.stack((own[i:], other[j:][::-1]), axis=1)
        children.append(pairs)
        names = np.concatenate((own[:i], other[:j], np.arange(nodes, nodes + met)))
        nodes += met
        rank = np.argsort(-sums, kind="stable")
        sums, names = sums[rank], names[rank]
        least = int(sums[-1]) if len(sums) == windows else 0
        heapq.heappush(heap, (least - int(sums[0]), serial, sums, names))
        serial += 1
    # from the windows down to the items: each node hands its window to its children
    below = np.concatenate(children) if children else np.zeros((0, 2), dtype=np.int64)
    window = np.full(nodes, -1, dtype=np.int64)
    window[heap[0][3]] = np.arange(len(heap[0][3]))
    for at in range(nodes - 1, n - 1, -1):
        window[below[at - n]] = window[at]
    order = np.argsort(window[:n], kind="stable")
    return np.split(order, np.flatnonzero(np.diff(window[order])) + 1)


def bundles(sizes: np.ndarray, small: int = SMALL_PIECE, target: int = BUNDLE) -> np.ndarray:
    """A number for each item: items below ``small`` are taken together to about ``target`` tokens, the others stand alone."""
    out = np.zeros(len(sizes), dtype=np.int64)
    tiny = sizes < small
    ends = np.cumsum(sizes[tiny])
    out[tiny] = (ends - 1) // target
    out[~tiny] = (out.max(initial=-1) + 1) + np.arange(int((~tiny).sum()))
    return np.unique(out, return_inverse=True)[1]


def fill(sizes: np.ndarray, capacity: int = CAPACITY) -> list[np.ndarray]:
    """Sets of indices with sums within ``capacity``; the number of sets rises until all fit.

    The differencing sees bundles of small items, so its work follows the tokens and not the number of items.
    """
    if not len(sizes):
        return []
    bundle = bundles(sizes)
    order = np.argsort(bundle, kind="stable")
    held = np.split(order, np.flatnonzero(np.diff(bundle[order])) + 1)
    total = np.bincount(bundle, weights=sizes).astype(np.int64)
    windows = max(1, math.ceil(int(sizes.sum()) / capacity))
    while True:
        sets = difference(total, windows)
        if all(int(total[x].sum()) <= capacity for x in sets):
            return [np.concatenate([held[i] for i in x]) for x in sets]
        windows += 1


def pack(cut: DataFrame, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Adds sequence_id and offset to piece rows. ``cut`` is read twice, so it should be a staged table.

    Full pieces keep a sequence each. Others are dealt by a hash of (doc_id, start) to as many groups as
    the total calls for, so a group has about ``group_windows`` windows at any input size.
    """
    whole = F.col("length") == capacity
    rest = cut.where(~whole)
    total = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, total // (capacity * group_windows))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], na_position="last", ignore_index=True)
        sizes = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        base = int(pdf["grp"].iloc[0]) << 32
        for i, own in enumerate(fill(sizes, capacity)):
            sequence[own] = base + i
            offset[own] = np.cumsum(sizes[own]) - sizes[own]
        return pdf.drop(columns="grp").assign(sequence_id=sequence, offset=offset)

    # a row number inside the hash spreads repeated (doc_id, start) rows as well
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id() % 64), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInPandas(one, schema)
    alone = cut.where(whole).select("*", (F.lit(-1).cast("long") - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have the end id alone. A very long text is cut into full windows and a rest.
    Repeated rows are packed each, ties in length go by id; a null id stays null.
    Other columns are ignored; an empty table gives an empty result. A worker remembers ``cache_entries`` words at most. Sequence ids are negative for
    full windows, and a group's number in the high 32 bits for the others.
    """
    return pack(staged(pieces(docs, tokenizer_path, end_id, id_col, text_col, capacity, cache_entries), "pieces"), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
