"""What the text operators share: session settings, tables, Arrow helpers and vector hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, cut, ship  # noqa: F401

#: Internal columns start with this, so that a caller's own columns never clash with them.
OWN = "__lf_"
#: Bytes of an Arrow batch, and Spark's setting for it. Spark's own 64 MB are held by each task of an executor outside its heap, and again, often
#: twice, by the task's Python worker.
BATCH_BYTES = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Python functions of this session get Arrow batches of about so many bytes at most (single longer rows go alone); a lower limit stays."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_LIMIT)) > most:
        spark.conf.set(BATCH_LIMIT, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """f over each Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def parts(b: pa.RecordBatch, column: int, rows: int = 1000, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and, but for single rows, about so many bytes of a text column: what a worker holds at once."""
    bytes_ = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        limit = (bytes_[at - 1] if at else 0) + size
        stop = min(at + rows, max(at + 1, int(np.searchsorted(bytes_, limit, "right"))))
        yield b.slice(at, stop - at)
        at = stop


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc_remainder(doc_id, mod: int):
    """crc32 of the id as decimal text, modulo mod (a Column); null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, for arrays of uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_CACHE: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_MULT**i and its inverse's powers modulo 2**64 for i < n, grown on demand."""
    have = _CACHE.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_MULT, -1, 1 << 64)
        for key, m in (("up", _MULT), ("down", inverse)):
            out = np.ones(size, _U)
            done, step = 1, m
            while done < size:  # doubles what is there
                out[done : 2 * done] = out[:done] * _U(step)
                done, step = 2 * done, step * step & _MASK
            _CACHE[key] = out
    return _CACHE["up"], _CACHE["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end] (uint8), the same wherever the bytes stand.

    A polynomial in the bytes modulo 2**64 from prefix sums, mixed with the length.
    """
    up, down = _powers(len(data) + 1)
    table = _CACHE.setdefault("bytes", mix64(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93)))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the maximal runs of word bytes; is_word: 256 booleans. Runs end at row ends."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    split = inner[(inside[inner] == 1) & (inside[inner + 1] == 1)] if len(inner) else inner  # a run crosses a row end here
    if len(split):
        starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
