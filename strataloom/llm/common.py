"""What the corpus operators share: durable intermediate tables, code shipping, text normal forms."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import shared_dir
from ..functions.shipping import ship  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/strataloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *, few: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. few: narrow rows are gathered into as few
    files as their size asks for, as every file costs calls (in a local folder processes, too)."""
    path = new_folder(df.sparkSession, name)
    if few:
        df = df.hint("rebalance")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what `written` wrote. Only for tables that nothing reads any more: whatever was made of them must have
    been written itself."""
    for df in tables:
        _delete(df.sparkSession, df._folder)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this library in the shared folder; results made from them must be kept elsewhere."""
    _delete(spark, f"{shared_dir(spark)}/strataloom")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df doesn't have, made from those wanted."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class Kept(dict):
    """Results of a function by key, in two generations of at most `limit` entries: when the newer one is full it
    becomes the older, so that what is used often stays. Long keys are never kept."""

    def __init__(self, make: Callable, limit: int, longest: int = 64):
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value


@contextlib.contextmanager
def no_collector() -> Iterator[None]:
    """Python's cycle collector rests while a task fills caches of plain bytes, which it would walk again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass a task's batches on; when the task ends, give the worker's free memory back, as the worker lives on beside
    whatever runs next. Caches of bounded size (words, a model) stay for the worker's next task."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
            ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values; each seed gives another order of them."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Which bytes are ASCII white space.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUES = mix(np.arange(256, dtype=np.uint64), 11)
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(_BLOCK, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS


def hash_words(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in UTF-8, in order, by array operations over its bytes. Words of 64 bytes or
    more are hashed one by one with xxh3, so that no long pattern can play on the arithmetic."""
    if len(data) > _BLOCK:
        out, part, size = [], [], 0
        for word in data.split():
            if len(word) >= 64:
                if part:
                    out.append(hash_words(b" ".join(part)))
                out.append(np.array([xxhash.xxh3_64_intdigest(word)], dtype=np.uint64))
                part, size = [], 0
                continue
            part.append(word)
            size += len(word) + 1
            if size > _BLOCK - 100:
                out.append(hash_words(b" ".join(part)))
                part, size = [], 0
        if part:
            out.append(hash_words(b" ".join(part)))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(data, np.uint8)
    edges = np.ones(len(raw) + 2, dtype=np.int8)
    edges[1:-1] = WHITE[raw]
    edges = np.diff(edges)
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    power, inverse = _powers()
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[raw] * power[: len(raw)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * inverse[starts], 12)
    for i in np.flatnonzero(ends - starts >= 64):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all windows of n words, in order; none when there are fewer words."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        out = np.full(m, n, dtype=np.uint64)
        for i in range(n):
            out = (out * np.uint64(0x9FB21C651E98DF25)) ^ hashes[i : i + m]
            out ^= out >> np.uint64(29)
    return mix(out)


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
