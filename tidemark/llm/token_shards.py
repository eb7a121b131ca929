"""Token shards in training order.

The ids of all documents, an end id after each, are cut into sequences of a fixed length, input
partition by input partition. A keyed Feistel permutation with cycle-walking gives the n-th of all
sequences its global slot, so the order is random, reproducible from the key, and needs no sort of
random numbers. Each shard is a range of slots and is written by one task as raw little-endian
unsigned 16-bit ids: sequence s starts at byte (s mod shard_rows) * 2 * length of its file, so a reader
can resume anywhere. Texts are tokenised once, into a staged table of compressed blocks of sequences;
from its counts the number of all sequences is known before anything is shuffled. On their way to the
shards, the sequences of many blocks that go to one shard are compressed together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_column, documents, looked_up, staged
from tidemark.llm.token_counts import LONGEST_CACHED, _processor, pre_tokens
from tidemark.session import shared_path

LENGTH = 1024
SHARD_ROWS = 16384
END_ID, PAD_ID = 2, 0
KEY = 0x5DEECE66D
ROUNDS = 6
ID_ENTRIES = 1_200_000
#: Sequences of a block of the staged table.
BLOCK_ROWS = 256
#: Bytes of ids that a task gathers before it sends them on, shard by shard.
GATHERED = 48 << 20
LEVEL = 3


def permuted(index: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """The slots of ``index`` under a keyed bijection of range(size).

    A balanced Feistel network permutes the smallest range of 2^(2h) numbers that holds ``size``; a
    number that falls outside is sent through again until it comes back inside.
    """
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = [np.uint64((key * (2 * r + 1) + 0x9E3779B97F4A7C15 * (r + 1)) & 0xFFFFFFFFFFFFFFFF) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> h, x & mask
        for k in keys:
            f = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << h) | right

    out = once(np.asarray(index, dtype=np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(size))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


class IdTable(dict):
    """Pre-token to its ids as little-endian unsigned 16-bit bytes, bounded in size.

    New pre-tokens are encoded as one text; each begins with the one id of its own that starts with the
    mark, so the ids are cut there. Pre-tokens with more marks are encoded one by one.
    """

    def __init__(self, path: str):
        super().__init__()
        self.model = _processor(path)
        size = self.model.get_piece_size()
        if size > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.starts = np.array([self.model.id_to_piece(i).startswith("▁") for i in range(size)])
        self.mark = np.array([self.model.piece_to_id("▁")], dtype="<u2").tobytes()

    def _one(self, key: bytes) -> bytes:
        return np.array(self.model.encode(key.decode("utf-8")), dtype="<u2").tobytes() if key else self.mark

    def learn(self, parts: set[bytes]) -> bool:
        new = {x for x in parts if x not in self}  # set.difference would go through the whole table
        if full := len(self) + len(new) > ID_ENTRIES:
            self.clear()
            new = parts
        plain = [x for x in new if x and b" " not in x and len(x) <= LONGEST_CACHED]
        self.update((x, self._one(x)) for x in new.difference(plain))
        for lo in range(0, len(plain), 2048):
            own = plain[lo : lo + 2048]
            ids = np.array(self.model.encode(b" ".join(own).decode("utf-8")), dtype="<u2")
            cut = np.flatnonzero(self.starts[ids])
            if len(cut) == len(own):
                data, at = ids.tobytes(), [*(2 * cut).tolist(), 2 * len(ids)]
                self.update((x, data[i:j]) for x, i, j in zip(own, at, at[1:], strict=False))
            else:
                self.update((x, self._one(x)) for x in own)
        return full


@lru_cache(maxsize=1)
def _id_table(path: str) -> IdTable:
    """The table of this worker: its tasks share it."""
    return IdTable(path)


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_shards(docs: DataFrame, path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY) -> DataFrame:
    """Write shards under ``path``; per sequence: slot, shard, position, n_tokens, ids_crc32, doc_ids.

    A sequence has ids of one input partition; the last of a partition is padded. Null and empty texts
    have the end id alone; a very long text goes on over as many sequences as it needs. Null ids are left out
    of doc_ids; repeated rows are written each, ties do not arise. Other columns are ignored; an empty table
    writes nothing. A shard is written beside its name and then moved, so a task that is run again replaces it
    whole (where the store's move is not atomic, a reader waits for the job's end).
    """
    spark = docs.sparkSession
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).cast("long").alias("id"), text_col)
    stride = 2 * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=LEVEL)
        table, end = _id_table(model_path), np.array([END_ID], dtype="<u2").tobytes()
        held, owners, part, first = bytearray(), [], None, 0

        def block(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, owners, first
            count = len(held) // stride + bool(last and len(held) % stride)
            if not count:
                return
            names, at = [], 0
            for i in range(count):
                while at < len(owners) and owners[at][1] <= i * stride:
                    at += 1
                j, own = at, []
                while j < len(owners) and owners[j][0] < (i + 1) * stride:
                    own.append(owners[j][2])
                    j += 1
                names.append([x for x in own if x is not None])
            done = count * stride
            data = press.compress(bytes(held[:done]))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([count], pa.int64()), pa.array([data], pa.binary()), pa.array([names], pa.list_(pa.list_(pa.int64())))], names=["part", "first", "n", "data", "doc_ids"])
            owners = [(a - done, b - done, x) for a, b, x in owners[at:] if b > done]
            held = held[done:]
            first += count

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            for doc, ids in zip(batch.column(1).to_pylist(), looked_up(byte_column(batch.column(2)), table, pre_tokens), strict=True):
                data = b"".join(ids) + end
                owners.append((len(held), len(held) + len(data), doc))
                held += data
                if len(held) >= BLOCK_ROWS * stride:
                    yield from block(False)
        if part is not None:
            yield from block(True)

    blocks = staged(rows.mapInArrow(cut, "part int, first bigint, n bigint, data binary, doc_ids array<array<bigint>>"), "id-blocks")
    starts, size = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one number for each input partition
        starts[r.part] = size
        size += r.n

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, expand = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        held: dict[int, list[tuple[int, bytes, list[int]]]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for shard, own in held.items():
                slots, pieces, names = zip(*own, strict=True)
                columns = [pa.array([shard], pa.int64()), pa.array([slots], pa.list_(pa.int64())), pa.array([[len(x) // 2 for x in pieces]], pa.list_(pa.int32())), pa.array([press.compress(b"".join(pieces))], pa.binary()), pa.array([names], pa.list_(pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "slots", "lengths", "data", "doc_ids"])

        size_held = 0
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, n, data, names = (batch.column(c)[row].as_py() for c in range(5))
                slots = permuted(np.arange(starts[part] + first, starts[part] + first + n), size, key).tolist()
                raw = expand.decompress(data)
                for i, (slot, own) in enumerate(zip(slots, names, strict=True)):
                    held.setdefault(slot // shard_rows, []).append((slot, raw[i * stride : (i + 1) * stride], own))
                size_held += len(raw)
                if size_held >= GATHERED:
                    yield from sent()
                    held, size_held = {}, 0
        yield from sent()

    def write(rows: pa.Table) -> pa.Table:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        number = rows["shard"][0].as_py()
        found = []
        for slots, lengths, data, names in zip(*(rows[c].to_pylist() for c in ("slots", "lengths", "data", "doc_ids")), strict=True):
            raw, ends = expand.decompress(data), np.cumsum(lengths).tolist()
            found += [(slot, raw[2 * (end - n) : 2 * end], own) for slot, n, end, own in zip(slots, lengths, ends, names, strict=True)]
        found.sort(key=lambda x: x[0])
        slots, pieces, names = zip(*found, strict=True)
        filled = [len(x) // 2 for x in pieces]
        pad = np.array([PAD_ID], dtype="<u2").tobytes()
        system, folder = _file_system(path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/shard-{number:08d}.bin"
        temporary = f"{folder}/.{number:08d}-{np.random.default_rng().integers(1 << 62):x}.part"
        with system.open_output_stream(temporary) as out:
            for x, n in zip(pieces, filled, strict=True):
                out.write(x + pad * (length - n))
        system.move(temporary, name)
        columns = {"slot": pa.array(slots, pa.int64()), "shard": pa.array([number] * len(slots), pa.int64()), "position": pa.array([x % shard_rows for x in slots], pa.int64()), "n_tokens": pa.array(filled, pa.int32())}
        return pa.table(columns | {"ids_crc32": pa.array([zlib.crc32(x) for x in pieces], pa.int64()), "doc_ids": pa.array(names, pa.list_(pa.int64()))})

    out = "slot bigint, shard bigint, position bigint, n_tokens int, ids_crc32 bigint, doc_ids array<bigint>"
    if not size:
        return spark.createDataFrame([], out)
    form = "shard bigint, slots array<bigint>, lengths array<int>, data binary, doc_ids array<array<bigint>>"
    return blocks.mapInArrow(spread, form).groupBy("shard").applyInArrow(write, out)


def read_slots(path: str, first: int, count: int, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> Iterator[np.ndarray]:
    """The sequences of ``count`` slots from ``first`` on, by sequential reads from the middle of a shard on."""
    system, folder = _file_system(path)
    slot = first
    while slot < first + count:
        shard, position = divmod(slot, shard_rows)
        info = system.get_file_info(f"{folder}/shard-{shard:08d}.bin")
        if info.type == pafs.FileType.NotFound:
            return
        with system.open_input_file(info.path) as source:
            source.seek(position * 2 * length)
            for _ in range(min(shard_rows - position, first + count - slot)):
                data = source.read(2 * length)
                if len(data) < 2 * length:
                    return
                yield np.frombuffer(data, dtype="<u2")
                slot += 1


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return write_shards(documents(spark, sf_dir), shared_path(spark, "shards", kept=True), public_tokenizers.path("piece_bpe_32k.model"))
