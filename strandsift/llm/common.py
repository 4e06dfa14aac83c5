"""Shared pieces of the training-data operators: scratch tables and text as bytes in numpy.

Conventions that hold for every operator here:

* ``doc_id``/``text``/``source`` may be null; a null text counts as an empty one.
* whole texts are processed; nothing is cut, capped or sampled unless a docstring says so.
* tables that are needed twice are written below ``spark.checkpoint.dir``, so a lost
  executor costs a re-read and never a wrong answer.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than blank and \\t..\\r.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


# ---------------------------------------------------------------- scratch tables
def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application in the cluster's shared folder, gone when the application ends. Only a local master may do
    without ``spark.checkpoint.dir``: a folder of one machine is no use to other machines."""
    at = getattr(spark, "_strandsift_scratch", None)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if at and (not path or at.startswith(path.rstrip("/"))):
        return at
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="strandsift-")
    at = f"{path.rstrip('/')}/{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    spark._strandsift_scratch = at
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column | str) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def smallest(df: DataFrame, key: Column, n: int) -> DataFrame:
    """About the ``n`` rows of ``df`` with the smallest non-null ``key``: found on the keys alone, so no task sends more than those
    rows (rows that share the last key all come)."""
    last = df.select(key.alias("k")).where("k IS NOT NULL").orderBy("k").limit(n).agg(F.max("k")).first()[0]
    return df.where(key <= last) if last is not None else df.limit(0)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (which compare case-insensitively)."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


# ---------------------------------------------------------------- text as bytes
def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and the n+1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.chunked_array([c.cast(pa.large_string()) for c in column.chunks], pa.large_string()).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges [i, j) of rows whose bytes together stay near ``most``; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of terms: ASCII letters and digits, and every byte of a code point beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return _LOWER[buf]


def words(buf: np.ndarray, offsets: np.ndarray, spells: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a run of bytes that ``spells`` marks), and the number of words before each row (n+1 values)."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = spells[buf]
    begins = np.zeros(len(buf) + 1, bool)
    begins[offsets] = True  # a row's first byte begins a word though the byte before it is none's end
    starts = np.flatnonzero((inside[1:-1] == 1) & ((inside[:-2] == 0) | begins[:-1]))
    ends = np.flatnonzero((inside[1:-1] == 1) & ((inside[2:] == 0) | begins[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- hashes
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finisher)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64
_POWERS = {"n": -1}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        n = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n + 1, base, U64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


class PrefixHash:
    """64-bit hashes of any substring of ``buf``, from one cumulative sum.

    hash(s, e) = sum of byte[s + k] * base**k modulo 2**64, scrambled together with the length.
    """

    def __init__(self, buf: np.ndarray):
        up, self.down = _powers(len(buf))
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all stretches of ``gram`` bytes; the high bits are the good ones."""
    up, down = _powers(len(buf))
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    out = (sums[gram:] - sums[:-gram]) * down[: len(buf) - gram + 1]
    out ^= out >> U64(32)
    out *= U64(0xBF58476D1CE4E5B9)
    out ^= out >> U64(29)
    out *= U64(0x94D049BB133111EB)
    return out


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(hashes) - n + 1, U64)
    for k in range(n):
        out = out * U64(_BASE) + hashes[k : k + len(out)]
    return mix(out)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` within each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row that each element belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word-shingle hashes of each row, sorted within the row, and their n+1 offsets.

    Words are compared with A-Z lower-cased; with fewer words than ``size`` the whole sequence is
    the one shingle; a row without words has none.
    """
    buf = lower(buf)
    starts, ends, first = words(buf, offsets)
    hashes = PrefixHash(buf)(starts, ends)
    n = np.diff(first)
    grams = chain(hashes, size)
    at, row = np.arange(len(grams)), row_of(first)
    full = first[1:][row[: len(grams)]] - at >= size if len(grams) else np.zeros(0, bool)
    keys, rows = grams[full], row[: len(grams)][full]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.zeros(len(short), U64)
        for k in range(size - 1):
            has = n[short] > k
            extra[has] = extra[has] * U64(_BASE) + hashes[first[short[has]] + k]
        keys = np.concatenate([keys, mix(extra ^ mix(n[short].astype(U64)))])
        rows = np.concatenate([rows, short])
    # sort by row, then hash: the sort runs row by row on slices that are already in place
    order = np.argsort(rows, kind="stable") if len(short) else slice(None)
    keys, rows = keys[order], rows[order]
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        keys[a:b].sort()
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    counts = per_row(new, bounds)
    return keys[new], np.concatenate([[0], np.cumsum(counts)])
