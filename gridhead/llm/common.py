"""What the operators share: table access, tables in the shared folder, sampling, and vectorised text hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridhead.sources.shared import shared_path

#: Code points that a block of texts holds at most (a longer text is a block of its own).
BLOCK_CHARS = 1_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage, and later plans know its size."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_key(df: DataFrame, key: str, columns: str) -> T.StructType:
    """The schema of `columns` behind the key of `df`, in the key's own type."""
    return T.StructType([T.StructField(key, df.schema[key].dataType), *T.StructType.fromDDL(columns).fields])


def partitions(df: DataFrame, least: int = 1) -> int:
    """Partitions for a shuffle whose volume follows the input's."""
    return max(least, df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def valid(text: str | Column) -> Column:
    """A text as it is; bytes that are no valid UTF-8 become U+FFFD, so that whatever reads the text can."""
    return F.make_valid_utf8(text)


def quoted(*names: str) -> list[str]:
    """Column names as references, whatever characters they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of `df` that are not called so, in whatever case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def unused(name: str, *frames: DataFrame) -> str:
    """`name`, lengthened until no column is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Hashes for sampling are whole numbers below this.
HASH_RANGE = 1 << 62


def hash_rank(*columns: str | Column) -> Column:
    """A whole number from 0 to `HASH_RANGE` by which rows are sampled."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)


def hash_bar(wanted: float, n: int) -> int:
    """Rows whose `hash_rank` is below this are about `wanted` of n (all, if there are no more); never 0, whatever n."""
    return min(HASH_RANGE, max(1, int(HASH_RANGE * wanted / max(n, 1))))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def word_chars() -> np.ndarray:
    """For each code point: does it belong to words (letters, digits, underscore, combining marks)?"""
    return np.fromiter((c.isalnum() or c == "_" or unicodedata.combining(c) != 0 for c in map(chr, range(0x110000))), bool, 0x110000)


def release_memory() -> None:
    """Gives freed memory back to the system: Python workers live on, and what they keep adds up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def blocks(lengths: list[int], limit: int = BLOCK_CHARS) -> Iterator[slice]:
    """Consecutive runs of texts of at most `limit` code points together; memory is released after the last one."""
    first = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield slice(first, i)
            first, total = i, 0
        total += n + 1
    if first < len(lengths):
        yield slice(first, len(lengths))
    release_memory()


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points, a line end after each, and where each text starts (one more entry than texts)."""
    flat = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return flat, starts


def word_spans(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    inside = np.zeros(len(flat) + 2, np.int8)
    inside[1:-1] = word_chars()[flat]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (non-empty, disjoint, ascending) span of code points."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    at = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(lengths.max()), _BASE))), dtype=np.uint64)
    chars = flat[at + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(chars * powers[at], offsets) + lengths.astype(np.uint64) * _MUL)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every word of the lower-cased texts, in order."""
    flat, begins = code_points([t.lower() for t in texts])
    starts, ends = word_spans(flat)
    return np.searchsorted(begins, starts, "right") - 1, span_hashes(flat, starts, ends)


def shingles(doc: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of `size` words inside one text."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = mix(total * _MUL + word[j : j + n] + np.uint64(j + 1))
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return at, total[at]
