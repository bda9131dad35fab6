"""Token-id output: fixed-width bit packing with block offsets.

An id takes the bits the vocabulary needs.  Groups of 64 ids fill ``width`` 64-bit
words exactly, so packing and unpacking are ``64`` column operations over all
groups, and any block is reached through its offset without reading the others.

File (little endian): ``TOKPACK1``, uint32 width, uint32 ids per block, uint64
documents, uint64 ids, int64 doc ids, uint8 null flags of the doc ids, uint64
document ends, uint64 block offsets (bytes from the first block, one more than
blocks), blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W

from phasegrid.llm.common import F, bounded_slices, column, crc32, materialize, open_fs, text_sizes
from phasegrid.llm.word_encoder import shared_encoder

MAGIC = b"TOKPACK1"
BLOCK_IDS = 4096
SHARD_IDS = 1 << 22
CHUNK_BYTES = 6 << 20


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids as 64-bit words; the last group is filled with zeros."""
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[:len(ids)] = ids
    cols = padded.reshape(groups, 64)
    out = np.zeros((groups, width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= cols[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= cols[:, j] >> np.uint64(64 - shift)
    return out.ravel()


def unpack(words: np.ndarray, width: int, count: int) -> np.ndarray:
    groups = words.reshape(-1, width)
    out = np.empty((len(groups), 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = groups[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (groups[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.ravel()[:count]


def pack_shard(ids: np.ndarray, ends: np.ndarray, docs: np.ndarray, nulls: np.ndarray, width: int,
               block_ids: int = BLOCK_IDS) -> bytes:
    if block_ids % 64:
        raise ValueError("ids per block must be a multiple of 64")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} does not fit {width} bits")
    words = pack(ids, width)
    blocks = -(-len(ids) // block_ids)
    offsets = np.minimum(np.arange(blocks + 1) * (block_ids // 64 * width), len(words)) * 8
    head = MAGIC + struct.pack("<IIQQ", width, block_ids, len(docs), len(ids))
    return b"".join([head, docs.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), ends.astype("<u8").tobytes(),
                     offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


class Shard:
    """Reader of one packed file held in memory or mapped."""

    def __init__(self, data: bytes | memoryview) -> None:
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a packed token file")
        self.width, self.block_ids, n_docs, self.n_ids = struct.unpack_from("<IIQQ", data, 8)
        at = 32
        self.docs = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        self.nulls = np.frombuffer(data, "u1", n_docs, at)
        at += n_docs
        self.ends = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.base, self.data = at + 8 * (blocks + 1), data

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start <= i < stop``; only the blocks that hold them are unpacked."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        lo, hi = int(self.offsets[first]), int(self.offsets[last + 1])
        words = np.frombuffer(self.data, "<u8", (hi - lo) // 8, self.base + lo)
        base = first * self.block_ids
        return unpack(words, self.width, stop - base)[start - base:]


def put(uri: str, data: bytes) -> None:
    """Write a file in one step: a repeated attempt replaces it whole."""
    fs, path = open_fs(uri)
    task = TaskContext.get()
    part = f"{path}.{task.taskAttemptId() if task else 0}.part"
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def write_packed(docs: DataFrame, out: str, tokenizer: str, end_id: int, vocabulary: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Encode texts and write packed shards below ``out`` in ascending order of ``id_col``.

    Every document ends with ``end_id``; a null text is empty.  Null ids come first;
    rows with the same id keep their own entry, in no promised order.  Returns the
    manifest: shard name, documents, ids.  Shards are named by their order.
    """
    ordered = (docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
               .repartitionByRange(F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first()))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, special_as_text)
        width = width_of(max(vocabulary or encoder.vocabulary, end_id + 1))
        task, shard, held, rows = TaskContext.get().partitionId(), 0, [], []
        size = 0

        def flush() -> None:
            nonlocal held, size, shard
            ids = np.concatenate([h[0] for h in held])
            ends = np.cumsum(np.concatenate([h[1] for h in held]))
            name = f"shard-{task:06d}-{shard:06d}.tok"
            put(f"{out}/{name}", pack_shard(ids, ends, np.concatenate([h[2] for h in held]),
                                            np.concatenate([h[3] for h in held]), width))
            rows.append((name, len(ends), len(ids)))
            held, size, shard = [], 0, shard + 1

        for batch in batches:
            texts = batch.column("text")
            sizes = text_sizes(texts)
            keys = batch.column("doc_id")
            null = np.array(keys.is_null())
            keys = keys.fill_null(0).to_numpy()
            for a, b in bounded_slices(sizes, CHUNK_BYTES):
                flat, counts = encoder.encode(texts.slice(a, b - a))
                ends = np.cumsum(counts + 1)
                ids = np.full(int(ends[-1]), end_id, np.uint32)
                keep = np.ones(len(ids), bool)
                keep[ends - 1] = False
                ids[keep] = flat
                held.append((ids, counts + 1, keys[a:b], null[a:b]))
                size += len(ids)
                if size >= SHARD_IDS:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                          pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], pa.int64())], ["shard", "n_docs", "n_ids"])

    return materialize(ordered.mapInArrow(write, "shard string, n_docs long, n_ids long"), "packed-manifest")


def read_packed(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Documents of packed shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has a row for each shard, so the running total over it is small.
    """
    base = manifest.select("shard", (F.sum("n_ids").over(W.orderBy("shard")) - F.col("n_ids")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(memoryview(content.as_buffer()))
                starts = np.concatenate([[0], shard.ends[:-1]]).astype(np.int64)
                sums = np.zeros(len(starts), np.int64)
                for a, b in bounded_slices(shard.ends - starts, 1 << 22):
                    ids = shard.ids(int(starts[a]), int(shard.ends[b - 1]))
                    for k in range(a, b):
                        sums[k] = crc32(ids[starts[k] - starts[a]:shard.ends[k] - starts[a]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(starts), pa.string()), pa.array(shard.docs, mask=shard.nulls.astype(bool)),
                     pa.array(starts), pa.array(shard.ends - starts), pa.array(sums)],
                    ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path)
             .select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content"))
    rows = files.mapInArrow(read, "shard string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
