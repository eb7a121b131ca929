"""Language-model scores from an n-gram trie of any order from two, in Elias-Fano form from level two on.

Level one is the vocabulary: sorted 64-bit word hashes and exact counts, neither of them compressed (the
base score is exact), a word's id being its place. Level two holds, for each context in the order of ids, its successors in the order of theirs. Pointer and
successor are one monotone sequence, place-of-context * vocabulary + successor, in Elias-Fano form, so
"does w follow u" is one successor search in the range of u. Next to each entry lies its smoothed
log probability in one byte. The level is dealt over files by a hash of the entry, so that neither a
frequent word nor a frequent context makes a file large; files lie in the shared folder and workers map
them into memory. Nothing passes through the driver but one number or two for each file.

Each further level has the same form, its contexts being the places of the entries one level up, and
lies in the file number of its first pair. A pair's successors are thus in one file, one entry for each.
All levels from two on come from one pass that counts the longest entries, with those that a text's end
cuts short: the counts of the shorter ones are sums of theirs.

p(w) = (c(w) + 1) / (N + V + 1), p(w|u) = (c(uw) + PRIOR p(w)) / (c(u) + PRIOR): Dirichlet smoothing,
whose back-off weight PRIOR / (c(u) + PRIOR) needs no further table. From level three on,
p(w|tu) = c(tuw) / (c(tu) + PRIOR) + PRIOR / (c(tu) + PRIOR) p(w|u), and so on: an entry keeps the first
term and a context its back-off weight, one byte each.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_column, documents, slices
from tidemark.llm.near_dedup import _mix
from tidemark.session import shared_path

PRIOR = 100.0
#: Width of a quantisation step of -log10 p, one byte holding 256 of them; it is wider where the tokens are so many that p falls below that.
STEP = 0.04
#: Stands for the end of a text; it holds a blank, so it is no word.
END = b"\n"
#: Rows that a task counts together, and the tokens behind them, whose counts have 32 bits.
COUNTED_WORDS, COUNTED_GRAMS, COUNTED_TOKENS = 2_000_000, 3_000_000, 1 << 31
#: Entries of one high part that a search goes through before it halves the rest.
FEW = 2
#: Words of the longest entries of the query's model.
ORDER = 3
#: Files of the levels from two on, as a multiple of those of level one, when there are more than two levels.
SPREAD = 4
SCORE_SLICE = 4 << 20


# ------------------------------------------------------------------ files of arrays


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def save_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON that says where each array lies, then the arrays; it appears when complete."""
    head, at, body = {}, 0, io.BytesIO()
    for name, a in arrays.items():
        body.write(b"\0" * (-at % 8))
        at += -at % 8
        head[name] = (at, a.dtype.str, len(a))
        body.write(a.tobytes())
        at += a.nbytes
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    system, target = _system(path)
    system.create_dir(target.rpartition("/")[0], recursive=True)
    temporary = f"{target}.{np.random.default_rng().integers(1 << 62):x}.part"
    with system.open_output_stream(temporary) as out:
        out.write(line)
        out.write(body.getbuffer())
    system.move(temporary, target)


def open_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped where the folder is mounted, else read."""
    system, target = _system(path)
    if isinstance(system, pafs.LocalFileSystem):
        data = np.asarray(np.memmap(target, dtype=np.uint8, mode="r"))
    else:
        with system.open_input_file(target) as source:
            data = np.frombuffer(source.read(), dtype=np.uint8)
    size = int(np.flatnonzero(data[: 1 << 16] == 10)[0]) + 1
    head = json.loads(bytes(data[:size]))
    return {k: data[size + at : size + at + n * np.dtype(t).itemsize].view(t) for k, (at, t, n) in head.items()}


# ------------------------------------------------------------------ Elias-Fano

_ZERO_IN_BYTE = np.array([[next((b for b in range(8) if not x >> b & 1 and sum(not x >> c & 1 for c in range(b)) == r), 8) for r in range(8)] for x in range(256)], dtype=np.uint8)


class Monotone:
    """A non-decreasing sequence: low bits in whole bytes, high parts in unary with a directory of zeros."""

    def __init__(self, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, shift: np.ndarray):
        self.low, self.high, self.zeros, self.bits = low, high, zeros, shift
        self.shift, self.mask = np.uint64(shift[0]), np.uint64((1 << int(shift[0])) - 1)

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> Monotone:
        """Low bits as the universe has room for an entry, less one to three as whole bytes allow: at three bits or more for the high parts, few entries share one."""
        room = (max(universe, 1) // max(len(values), 1)).bit_length()
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if room - 4 <= 8 * np.dtype(k).itemsize)
        spare = min(max(0, room - 2), 8 * np.dtype(kind).itemsize, 63)
        top = (values >> np.uint64(spare)).astype(np.int64)
        bits = np.zeros(-(-(len(values) + (universe >> spare) + 2) // 64) * 64, dtype=bool)
        bits[top + np.arange(len(values))] = True
        high = np.packbits(bits, bitorder="little").view("<u8")
        empty = 64 - np.bitwise_count(high).astype(np.int64)
        return cls((values & np.uint64((1 << spare) - 1)).astype(kind), high, (np.cumsum(empty) - empty).astype(np.uint32 if len(bits) < 1 << 32 else np.uint64), np.array([spare], dtype=np.uint8))

    def arrays(self, name: str = "") -> dict[str, np.ndarray]:
        return {f"low{name}": self.low, f"high{name}": self.high, f"zeros{name}": self.zeros, f"bits{name}": self.bits}

    @classmethod
    def read(cls, arrays: dict[str, np.ndarray], name: str = "") -> Monotone:
        return cls(*(arrays[f"{part}{name}"] for part in ("low", "high", "zeros", "bits")))

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Bit positions of the k-th zeros."""
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), side="right") - 1
        left, free, at = k - self.zeros[word].astype(np.int64), ~self.high[word], word * 64
        for width in (32, 16, 8):
            lower = np.bitwise_count(free & np.uint64((1 << width) - 1))
            over = left >= lower
            left -= lower * over
            free >>= over * np.uint64(width)
            at += over * width
        return at + _ZERO_IN_BYTE[255 - (free & np.uint64(255)).astype(np.int64), left]

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1: the successor search, ending in a comparison."""
        out = np.full(len(values), -1, dtype=np.int64)
        if not len(values) or not len(self.low):
            return out
        top = (values >> self.shift).astype(np.int64)
        bit = np.where(top > 0, self._zero(np.maximum(top - 1, 0)) + 1, 0)
        live, at, low = np.arange(len(values)), bit - top, (values & self.mask).astype(self.low.dtype)
        for _ in range(FEW):  # a set bit for each entry with these high parts, then a zero
            inside = np.flatnonzero(self.high[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
            live, at, bit, low = live[inside], at[inside], bit[inside], low[inside]
            got = self.low[at]
            hit = got == low
            out[live[hit]] = at[hit]
            more = np.flatnonzero(got < low)
            live, at, bit, low = live[more], at[more] + 1, bit[more] + 1, low[more]
        if len(live):  # contexts with many successors: halve what is left
            last = self._zero(top[live]) - top[live] - 1
            live, at, low, last = (x[at <= last] for x in (live, at, low, last))
            while (at < last).any():
                half = (at + last) >> 1
                under = self.low[half] < low
                at, last = np.where(under, np.minimum(half + 1, last), at), np.where(under, last, half)
            hit = self.low[at] == low
            out[live[hit]] = at[hit]
        return out


# ------------------------------------------------------------------ vocabulary


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _shard_of_hash(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes, so that shards in order are hashes in order."""
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _planes(a: np.ndarray) -> bytes:
    """First bytes, second bytes and so on: the high ones are mostly zero."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _pack(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Sorted rows (64-bit key, words after it) and counts below 2**32, compressed; keys as differences."""
    import zstandard

    parts = [np.diff(columns[0], prepend=np.uint64(0)), *(c.astype("<u4") for c in columns[1:]), counts.astype("<u4")]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(counts).to_bytes(8, "little"), *map(_planes, parts)]))


def _unpack(data: bytes, tails: int) -> list[np.ndarray]:
    """The columns, and the counts as the last one."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in ("<u8", *["<u4"] * (tails + 1)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T).view(kind).ravel())
        at += size * n
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _unpacked(blobs: list[bytes], tails: int) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*(_unpack(x, tails) for x in blobs), strict=True)]


def _dealt(columns: list[np.ndarray], counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """Rows (shard, data) of sorted rows."""
    order = np.argsort(shard, kind="stable")
    columns, counts, shard = [c[order] for c in columns], counts[order], shard[order]
    names, starts = np.unique(shard, return_index=True)
    ends = np.append(starts[1:], len(shard))
    data = [_pack([c[a:b] for c in columns], counts[a:b]) for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(data, pa.binary())], names=["shard", "data"])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of their counts, and the place of each key given."""
    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64), place


def _counted(columns: list[np.ndarray], words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows (pair, 1 + word or 0 for none, ...) in order, with counts."""
    keys, levels = columns[0], []
    for column in columns[1:]:
        known, place = np.unique(keys, return_inverse=True)
        levels.append(known)
        keys = place.astype(np.uint64) * np.uint64(words + 1) + column
    keys, counts = np.unique(keys, return_counts=True)
    out = []
    for known in reversed(levels):
        out.append((keys % np.uint64(words + 1)).astype("<u4"))
        keys = known[(keys // np.uint64(words + 1)).astype(np.int64)]
    return [keys, *reversed(out)], counts


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words and the end of a text after them, the place there of each token, text after text, and the number of tokens of each text."""
    lower = pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    parts = pc.ascii_split_whitespace(lower)
    coded, offsets = parts.flatten().dictionary_encode(), parts.offsets.to_numpy()
    words, codes = coded.dictionary.view(pa.large_binary()).to_pylist(), coded.indices.to_numpy()
    if b"" in words:  # before a blank at the start or after one at the end
        real = codes != words.index(b"")
        offsets, codes = np.concatenate(([0], np.cumsum(real)))[offsets], codes[real]
    n = np.diff(offsets).astype(np.int64) + 1
    tokens = np.full(int(n.sum()), len(words), dtype=np.int64)
    inner = np.ones(len(tokens), dtype=bool)
    inner[np.cumsum(n) - 1] = False
    tokens[inner] = codes
    return [*words, END], tokens, n


class Vocabulary:
    """Words to ids; the level's files are mapped."""

    def __init__(self, path: str, sizes: list[int]):
        self.shards, self.bases = len(sizes), np.cumsum([0, *sizes])
        self.files = [open_arrays(f"{path}/words-{i}") if n else None for i, n in enumerate(sizes)]

    def look(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts, -1 and 0 for unknown words."""
        h = _hashes(words)
        order = np.argsort(h)
        h, ids, counts = h[order], np.full(len(h), -1, dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        shard = _shard_of_hash(h, self.shards)
        for s in np.unique(shard).tolist():
            if self.files[s] is not None:
                lo, hi = np.searchsorted(shard, [s, s + 1])
                keys = self.files[s]["keys"]
                at = np.minimum(np.searchsorted(keys, h[lo:hi]), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == h[lo:hi])
                ids[order[lo + hit]], counts[order[lo + hit]] = at[hit] + self.bases[s], self.files[s]["counts"][at[hit]]
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ids in order."""
        out, cuts = np.zeros(len(ids), dtype=np.int64), np.searchsorted(ids, self.bases)
        for s, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if lo < hi:
                out[lo:hi] = self.files[s]["counts"][ids[lo:hi] - self.bases[s]]
        return out


@lru_cache(maxsize=1)
def _vocabulary(path: str, sizes: tuple[int, ...]) -> Vocabulary:
    return Vocabulary(path, list(sizes))


def _contexts(n: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The id before each token; -2 for the first of a text."""
    out = np.concatenate(([-2], ids[:-1])) if len(ids) else ids
    out[np.cumsum(n) - n] = -2
    return out


def _step(tokens: int) -> float:
    """The step with which no p of an entry is below the last value: p is 1 / (tokens + PRIOR) at least."""
    return max(STEP, float(np.log10(tokens + PRIOR)) / 255)


def _byte(p: np.ndarray, step: float) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) / step), 0, 255).astype(np.uint8)


def _shard_of_pair(keys: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(keys) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


# ------------------------------------------------------------------ model


class Model:
    """What scoring needs to know beside the files."""

    def __init__(self, path: str, sizes: tuple[int, ...], tokens: int, shards: int, filled: frozenset[int], deeper: tuple[frozenset[int], ...] = ()):
        self.path, self.sizes, self.tokens, self.shards, self.filled, self.deeper = path, sizes, tokens, shards, filled, deeper

    @property
    def words(self) -> int:
        return sum(self.sizes)

    @property
    def values(self) -> np.ndarray:
        """The probability of each byte."""
        return 10.0 ** (-_step(self.tokens) * np.arange(256))


def count_words(texts: DataFrame, path: str, shards: int) -> tuple[tuple[int, ...], int]:
    """Write level one; sizes of its files and the number of tokens."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, behind = [], 0, 0

        def flush() -> pa.RecordBatch:
            keys, counts, _ = _summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
            return _dealt([keys], counts, _shard_of_hash(keys, shards))

        for batch in batches:
            data = byte_column(batch.column(0))
            for lo, hi in slices([len(x) for x in data], SCORE_SLICE):
                words, found, n = split_words(data[lo:hi])
                counts = np.bincount(found, minlength=len(words))
                held.append((_hashes(words)[counts > 0], counts[counts > 0]))
                size, behind = size + len(held[-1][0]), behind + len(found)
                if size > COUNTED_WORDS or behind > COUNTED_TOKENS:
                    yield flush()
                    held, size, behind = [], 0, 0
        if held:
            yield flush()

    def merge(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        keys, counts, _ = _summed(*_unpacked(rows["data"].to_pylist(), 0))
        save_arrays(f"{path}/words-{shard}", {"keys": keys, "counts": counts})
        return pa.table({"shard": pa.array([shard], pa.int64()), "size": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    got = texts.mapInArrow(local, "shard bigint, data binary").groupBy("shard").applyInArrow(merge, "shard bigint, size bigint, tokens bigint").collect()
    sizes = [0] * shards
    for r in got:
        sizes[r.shard] = r.size
    return tuple(sizes), sum(r.tokens for r in got)


def count_grams(texts: DataFrame, path: str, order: int, sizes: tuple[int, ...], tokens: int, shards: int) -> list[frozenset[int]]:
    """Write the levels from two to ``order``; the numbers of the files of each."""
    words, step = sum(sizes), _step(tokens)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, size = _vocabulary(path, sizes), [], 0

        def flush() -> pa.RecordBatch:
            columns, counts = _counted([np.concatenate(c) for c in zip(*held, strict=True)], words)
            return _dealt(columns, counts, _shard_of_pair(columns[0], shards))

        for batch in batches:
            data = byte_column(batch.column(0))
            for lo, hi in slices([len(x) for x in data], SCORE_SLICE):
                names, found, n = split_words(data[lo:hi])
                ids = vocabulary.look(names)[0][found]
                left = np.repeat(np.cumsum(n), n) - np.arange(len(ids))
                at = np.flatnonzero(left > 1)
                held.append([(ids[at].astype(np.uint64) << np.uint64(32)) | ids[at + 1].astype(np.uint64)])
                for i in range(2, order):
                    held[-1].append(np.where(left[at] > i, ids[np.minimum(at + i, len(ids) - 1)] + 1, 0).astype("<u4"))
                size += len(at)
                if size > COUNTED_GRAMS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(rows: pa.Table) -> pa.Table:
        shard, levels = rows["shard"][0].as_py(), [2]
        keys, *tails, counts = _unpacked(rows["data"].to_pylist(), order - 2)
        keys, total, place = _summed(keys, counts)
        vocabulary = _vocabulary(path, sizes)
        left, right = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        contexts, context = np.unique(left, return_inverse=True)
        followers, follower = np.unique(right, return_inverse=True)
        alone = (vocabulary.counts_of(followers)[follower] + 1) / (tokens + words + 1)
        p = (total + PRIOR * alone) / (vocabulary.counts_of(contexts)[context] + PRIOR)
        first = Monotone.of(contexts.astype(np.uint64), words + 1)
        pairs = Monotone.of(context.astype(np.uint64) * np.uint64(words) + right.astype(np.uint64), len(contexts) * words + 1)
        save_arrays(f"{path}/pairs-{shard}", first.arrays("1") | pairs.arrays("2") | {"p": _byte(p, step)})
        for level in range(3, order + 1):
            goes_on = np.flatnonzero(tails[level - 3])
            if not len(goes_on):
                break
            above, place, counts, tails = len(keys), place[goes_on], counts[goes_on], [t[goes_on] for t in tails]
            keys, total, place = _summed(place.astype(np.uint64) * np.uint64(words) + (tails[level - 3] - np.uint32(1)), counts)
            context = (keys // np.uint64(words)).astype(np.int64)
            given = np.bincount(context, weights=total, minlength=above)
            own = Monotone.of(keys, above * words + 1)
            save_arrays(f"{path}/grams{level}-{shard}", own.arrays() | {"p": _byte(total / (given[context] + PRIOR), step), "back": _byte(PRIOR / (given + PRIOR), step)})
            levels.append(level)
        return pa.table({"shard": pa.array([shard] * len(levels), pa.int64()), "level": pa.array(levels, pa.int64())})

    got = texts.mapInArrow(local, "shard bigint, data binary").groupBy("shard").applyInArrow(merge, "shard bigint, level bigint").collect()
    return [frozenset(r.shard for r in got if r.level == level) for level in range(2, order + 1)]


def fit(docs: DataFrame, path: str, text_col: str = "text", order: int = 2) -> Model:
    """Count all of ``docs`` and write the trie under ``path``, with entries of up to ``order`` words.

    Level one has as many files as there are shuffle partitions.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = parts * (SPREAD if order > 2 else 1)
    texts = docs.select(text_col)
    sizes, tokens = count_words(texts, path, parts)
    filled, *deeper = count_grams(texts, path, order, sizes, tokens, shards) if tokens else [frozenset()]
    return Model(path, sizes, tokens, shards, filled, tuple(deeper))


@lru_cache(maxsize=1)
def _pairs(path: str, filled: frozenset[int]) -> dict[int, tuple[Monotone, Monotone, np.ndarray]]:
    out = {}
    for s in filled:
        a = open_arrays(f"{path}/pairs-{s}")
        out[s] = (Monotone.read(a, "1"), Monotone.read(a, "2"), a["p"])
    return out


@lru_cache(maxsize=8)
def _grams(path: str, level: int, filled: frozenset[int]) -> dict[int, tuple[Monotone, np.ndarray, np.ndarray]]:
    out = {}
    for s in filled:
        a = open_arrays(f"{path}/grams{level}-{s}")
        out[s] = (Monotone.read(a), a["p"], a["back"])
    return out


def _by_file(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their files, and where each file's begin."""
    shard = shard.astype(np.uint16 if shards < 1 << 16 else np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _refine(model: Model, level: int, p: np.ndarray, ids: np.ndarray, n: np.ndarray, place: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bring one level more into ``p``; places and files of the entries that end at each token.

    ``place`` and ``shard`` are those of the entries of the level before, -1 where there is none.
    """
    live = place >= 0
    live[np.cumsum(n) - 1] = False
    at = np.flatnonzero(live)
    order, cuts = _by_file(shard[at], model.shards)
    at = at[order]
    found, files, values = np.full(len(ids), -1, dtype=np.int64), np.full(len(ids), -1, dtype=np.int64), model.values
    for s, (grams, own_p, back) in _grams(model.path, level, model.deeper[level - 3]).items():
        own = at[cuts[s] : cuts[s + 1]]
        if not len(own):
            continue
        word, context = ids[own + 1], place[own]
        value = p[own + 1] * values[back[context]]
        seen = np.flatnonzero(word >= 0)
        keys, where = np.unique(context[seen].astype(np.uint64) * np.uint64(model.words) + word[seen].astype(np.uint64), return_inverse=True)
        got = np.full(len(own), -1, dtype=np.int64)
        got[seen] = grams.find(keys)[where]
        hit = np.flatnonzero(got >= 0)
        value[hit] += values[own_p[got[hit]]]
        p[own + 1] = value
        found[own + 1], files[own + 1] = got, s
    return found, files


def score_texts(model: Model, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base score and model score of each text."""
    vocabulary, files, values = _vocabulary(model.path, model.sizes), _pairs(model.path, model.filled), model.values
    names, found, n = split_words(texts)
    word, count = vocabulary.look(names)
    alone = (count + 1) / (model.tokens + 1 * (model.words + 1))
    starts, ids = np.cumsum(n) - n, word[found]
    before = _contexts(n, ids)
    rest = np.concatenate(([1.0], (PRIOR / (count + PRIOR))[found[:-1]]))
    rest[starts] = 1.0
    p = alone[found] * rest
    pair = np.flatnonzero((before >= 0) & (ids >= 0))
    keys = (before[pair].astype(np.uint64) << np.uint64(32)) | ids[pair].astype(np.uint64)
    keys, back = np.unique(keys, return_inverse=True)
    shard = _shard_of_pair(keys, model.shards).astype(np.int64)
    order, cuts = _by_file(shard, model.shards)
    value, places = np.zeros(len(keys)), np.full(len(keys), -1, dtype=np.int64)
    for s, (contexts, pairs, own_p) in files.items():
        own = order[cuts[s] : cuts[s + 1]]
        left = keys[own] >> np.uint64(32)
        new = np.concatenate((np.ones(len(left[:1]), dtype=bool), left[1:] != left[:-1]))
        place = contexts.find(left[new])[np.cumsum(new) - 1]
        own, place = own[place >= 0], place[place >= 0]
        at = pairs.find(place.astype(np.uint64) * np.uint64(model.words) + (keys[own] & np.uint64(0xFFFFFFFF)))
        value[own[at >= 0]] = values[own_p[at[at >= 0]]]
        places[own] = at
    value = value[back]
    known = np.flatnonzero(value)
    p[pair[known]] = value[known]
    place, file = np.full(len(ids), -1, dtype=np.int64), np.full(len(ids), -1, dtype=np.int64)
    place[pair], file[pair] = places[back], shard[back]
    for level in range(3, 3 + len(model.deeper)):
        place, file = _refine(model, level, p, ids, n, place, file)
    return n, np.add.reduceat((count > 0).astype(np.int64)[found], starts), np.add.reduceat(np.log10(alone)[found], starts), np.add.reduceat(np.log10(p), starts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Null and empty texts have the end token alone; very long texts are scored whole. With nothing learned,
    every token is unknown. Repeated rows are scored each, ties do not arise; other columns, whatever their
    names, are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_column(batch.column(1))
            for lo, hi in slices([len(x) for x in texts], SCORE_SLICE):
                n, known, base, own = score_texts(model, texts[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(own)], names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out(id_col: str = "doc_id", parts: int = 7, part: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()), shared_path(spark, "trie"), order=ORDER)
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
