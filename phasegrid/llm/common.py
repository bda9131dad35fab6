"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from phasegrid.session import materialize, scratch_path, ship_package

__all__ = ["F", "binary_buffer", "bounded_slices", "column", "materialize", "mix64", "open_fs", "release", "scratch_path",
           "ship_package", "table", "text_sizes"]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def column(name: str):
    """Column by exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (fixed public constants of a murmur finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; null has none."""
    return pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)


@functools.cache
def _c_library() -> ctypes.CDLL | None:
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except (OSError, TypeError):
        return None


def release() -> None:
    """Give memory that Arrow and the C library keep for reuse back, as workers live on and take turns at different work."""
    pa.default_memory_pool().release_unused()
    if _c_library() is not None:
        _c_library().malloc_trim(0)


def binary_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null rows are empty."""
    col = col.fill_null("") if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col.fill_null(b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def bounded_slices(sizes: np.ndarray, limit: int):
    """(from, to) row ranges whose sizes sum to ``limit`` at most, or single rows."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is on the shared mount."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def crc32(ids: np.ndarray) -> int:
    """Checksum of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()) & 0xFFFFFFFF
