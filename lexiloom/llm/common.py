"""Shared helpers: shared-storage checkpoints, Arrow text access and vectorised 64-bit digests."""

from __future__ import annotations

import ctypes
import hashlib
import math
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xC2B2AE3D27D4EB4F)
BYTE_RANK = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)

#: A-Z to a-z on bytes, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that separate words under `[^\x20\x09-\x0D]+`.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, A_Z, a_z)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process may do without."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexiloom-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the cluster's shared checkpoint folder, so that later reads survive lost executors."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(df: DataFrame, total_bytes: int | None = None, per: int = 16 << 20) -> int:
    """Shuffle partitions: the session's number, or more if total_bytes asks for them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(n, math.ceil((total_bytes or 0) / per))


def give_back() -> None:
    """Return freed memory to the system: a worker process lives on beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def handing_back(fn):
    """fn over Arrow batches; when a task ends, its worker gives memory back."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (bytes, offsets); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def slices(offsets: np.ndarray, limit: int = 2 << 20):
    """Row ranges [i, j) of about `limit` bytes, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= M1
    x ^= x >> np.uint64(29)
    x *= M2
    x ^= x >> np.uint64(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The digest of a string from those of its two parts."""
    x = a * M1
    x += b
    x ^= x >> np.uint64(29)
    x *= M2
    x ^= x >> np.uint64(32)
    return x


def double(ranks: np.ndarray, n: int, to: int, axis: int = 0) -> np.ndarray:
    """Digests of all strings of length `to` from those of length n, by prefix doubling along an axis."""
    r = np.moveaxis(ranks, axis, -1)
    while n * 2 <= to:
        r = pair(r[..., :-n], r[..., n:]) if r.shape[-1] > n else r[..., :0]
        n *= 2
    if n < to:
        d = to - n
        r = pair(r[..., :-d], r[..., d:]) if r.shape[-1] > d else r[..., :0]
    return np.moveaxis(r, -1, axis)


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of bytes that are no separators, within documents."""
    gap = np.ones(len(data) + 1, bool)
    gap[1:] = False
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    first[bounds] = inside[bounds]
    last[bounds - 1] = inside[bounds - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: Spans up to so many bytes are digested side by side, longer ones by blake2b.
LANES = 8
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each byte span: lanes of 8 bytes are taken in one by one, each through a full mix.

    Two different spans share a digest with a chance of 2^-64; no structure of the bytes raises it.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) * M2 + M1)
    open_ = np.flatnonzero(size <= 8 * LANES)
    at, left = starts[open_], size[open_]
    while len(open_):
        out[open_] = mix((out[open_] ^ (lanes[at] & _MASK[np.minimum(left, 8)])) * M1 + M2)
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out
