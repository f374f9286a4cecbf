"""What the operators share: stored tables, Arrow slices, hashes.

All hashing here is deterministic, so that a task that is run again after a lost
executor gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.session import load
from sparrel.shipping import ship
from sparrel.stored import folder

#: Text is worked on in slices of about so many bytes, which bounds a worker's memory.
SLICE_BYTES = 2_500_000
#: Rows of a stored table (of about 40 bytes) that are broadcast at most.
MOST_BROADCAST = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``."""
    return folder(spark, tag)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(table: DataFrame, rows: int = MOST_BROADCAST) -> DataFrame:
    """A stored table, to be broadcast if it has so many rows or fewer; if not, both sides of a join are shuffled."""
    return F.broadcast(table) if table.count() <= rows else table


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of a value's decimal text, modulo n; NULL for NULL."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % F.lit(n)


def slices(batch: pa.RecordBatch, col: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes in a string column; a longer row stands alone."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_slices(df: DataFrame, col: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of text; ``fn`` gets a slice and returns a batch in ``schema``."""
    at = df.columns.index(col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, at, limit):
                if (out := fn(part)) is not None and out.num_rows:
                    yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256), _BASE, np.uint64)]))
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary array; NULL counts as empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    n = len(arr)
    if off is None or n == 0:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], data


def hash64(arr: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value's bytes, the same in every process."""
    off, data = raw(arr)
    lens = np.diff(off)
    out = np.zeros(len(lens), np.uint64)
    if len(data):
        pos = np.arange(len(data)) - np.repeat(off[:-1], lens)
        with np.errstate(over="ignore"):
            v = _BYTE[data] * _powers(int(lens.max()) + 1)[pos]
            full = lens > 0
            out[full] = np.add.reduceat(v, off[:-1][full])
    with np.errstate(over="ignore"):
        return mix(out + lens.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text, flat, and where each text's words begin (n + 1 offsets)."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    off = np.asarray(parts.offsets).astype(np.int64)
    off -= off[0]
    full = pc.greater(pc.binary_length(flat), 0)
    mask = full.to_numpy(zero_copy_only=False)
    if not mask.all():
        seen = np.concatenate([[0], np.cumsum(mask)])
        flat, off = flat.filter(full), seen[off]
    return flat, off


def coded(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and each value's index in them."""
    d = flat.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False)


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each of many spans, one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def string_array(data: np.ndarray, off: np.ndarray, kind=None) -> pa.Array:
    """A (large) string or binary array over bytes that are there already."""
    kind = kind or pa.large_binary()
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    off = np.ascontiguousarray(off, np.int64 if wide else np.int32)
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def sample_fraction(total: float, wanted: float) -> float:
    return 1.0 if total <= wanted else wanted / total


def hashed_share(col: Column, share: Column | float, salt: int) -> Column:
    """True for a share of rows, by a hash of ``col``: the same rows in every run."""
    return (F.xxhash64(col.cast("string"), F.lit(salt)).bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(0x1000000))) < share
