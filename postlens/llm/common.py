"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import struct
import sys
import weakref
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from postlens.session import stage_path

#: Bytes of text that a task turns into arrays at a time (longer texts go alone).
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's own switch: an execution's shuffle files go when it ends (a lost one is made anew)
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a block; the caller's is put back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stage(df: DataFrame, tag: str = "llm") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: its input is
    computed once, the lineage is cut, lost executors cost nothing, and the shuffle files of
    the write are dropped as soon as it is done."""
    spark = df.sparkSession
    path = stage_path(spark, tag)
    with setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of stages that are written and no longer referred
    to; it does so only after the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
              keep_caches: bool = False) -> DataFrame:
    """``fn`` over every Arrow batch; batches for which it gives None are left out.
    keep_caches: for operators that use a word cache from task to task."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_caches:
            forget()
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out
    return df.mapInArrow(run, schema)


def chunks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` with about ``limit`` characters each."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


#: tables of loaded tokenizers, emptied with the caches
HELD: list[dict] = []


def forget() -> None:
    """Empty the caches and tokenizers that an earlier stage has left in this worker process,
    and give their memory back to the system: workers outlive stages, so what one stage leaves
    would add to what the next one needs."""
    for held in [*BoundedCache.every, *HELD]:
        held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class BoundedCache(dict):
    """A dict that starts anew when it holds ``most`` entries: memory stays bounded, and
    since words follow a steep law the frequent ones are back at once."""

    every: weakref.WeakSet[BoundedCache] = weakref.WeakSet()
    __hash__ = object.__hash__

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.every.add(self)

    def put(self, key, value):
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


# ---- word hashing over whole batches of texts -------------------------------------------

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _byte_codes(fold: bool) -> np.ndarray:
    b = np.arange(256, dtype=np.uint64)
    if fold:
        b[65:91] += U(32)
    return mix(b * U(0x9E3779B97F4A7C15) + U(0x5851F42D4C957F2D)) | U(1)


_CODES = {f: _byte_codes(f) for f in (False, True)}
_R = 0xD1342543DE82EF95
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """r^0 .. r^(n-1) modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 4096), _R, np.uint64)
            p[0] = 1
            _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a list of texts, as arrays.

    ``buf``: all bytes; ``start``, ``end``: byte span of each word in ``buf``; ``doc``:
    index of its text; ``count``: words of each text; ``first``: index of each text's
    first word; ``hash``: 64-bit word codes (A-Z folded if ``fold``)."""

    def __init__(self, texts: list, fold: bool = False):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        space = _SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(raw)), self.count)
        self.hash = self._hash(~space, fold)

    def _hash(self, inside: np.ndarray, fold: bool) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        code = _CODES[fold][self.buf[inside]] * _powers(int(size.max()))[place]
        return mix(np.add.reduceat(code, at) + size.astype(np.uint64))

    def window_hash(self, k: int, salt: int = 0) -> np.ndarray:
        """A hash of every run of ``k`` words in a row, by first word (runs across two
        texts included: ``inside(k)`` tells the proper ones)."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.full(n, salt, np.uint64)
        for i in range(k):
            h *= U(0x9FB21C651E98DF25)
            h += self.hash[i:i + n]
        return mix(h)

    def inside(self, k: int) -> np.ndarray:
        n = len(self.doc) - k + 1
        return self.doc[:n] == self.doc[k - 1:] if n > 0 else np.zeros(0, bool)
