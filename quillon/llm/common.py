"""Shared pieces of the corpus operators: shared-folder tables, word hashing and Arrow helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.graph import shared_folder

#: Odd 64-bit constants of the multiplicative hashes.
GOLDEN = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_KEPT: dict[str, Any] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete a table made by written() that nothing lazy reads any more."""
    path = getattr(df, "_quillon_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def over_arrow(df: DataFrame, columns: list[str], schema: str | StructType, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], most: int = 4 << 20) -> DataFrame:
    """Apply fn to each Arrow batch of the columns, in slices of about `most` bytes; None yields nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, most):
                out = fn(piece)
                if out is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()
        batch = piece = out = None
        at_rest()

    return df.select(*columns).mapInArrow(run, schema)


def at_rest() -> None:
    """Give back to the system what this worker's task no longer uses: Spark keeps the worker beside the executor for tasks to come."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What this worker keeps from task to task under a name: one thing at a time, so what an earlier step kept goes when the next one begins."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def rows_where(df: DataFrame, column: str, keep: Callable[[list[bytes | None]], list[bool]]) -> DataFrame:
    """The rows of df, with all columns, that keep() says yes to, given the UTF-8 texts of a column."""
    at = df.columns.index(column)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(keep(raw(batch.column(at))), pa.bool_()))

    return over_arrow(df, df.columns, df.schema, run)


def pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes, one row at least; bounds memory where texts are long."""
    if batch.num_rows <= 1 or batch.nbytes <= most:
        yield batch
        return
    step = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """Word bytes to a 64-bit hash, remembered up to `most` words."""

    def __init__(self, most: int = 200_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes() -> WordHashes:
    """This worker's hashes of words, kept from task to task."""
    return kept("hashes", WordHashes)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values: sum of value * BASE^i, brought to a common offset."""

    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._power) < n:
            size = max(n, 2 * len(cls._power), 1 << 15)
            for name, base in (("_power", BASE), ("_inverse", BASE_INVERSE)):
                values = np.full(size, base, np.uint64)
                values[0] = 1
                setattr(cls, name, np.multiply.accumulate(values))
        return cls._power, cls._inverse

    def __init__(self, values: np.ndarray) -> None:
        power, self.inverse = self.powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])
        self.n = len(values)

    def windows(self, width: int) -> np.ndarray:
        """The hash of each window of `width` values."""
        if self.n < width:
            return np.zeros(0, np.uint64)
        count = self.n - width + 1
        return mixed((self.sums[width:] - self.sums[:count]) * self.inverse[:count])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of the stretches [start, end)."""
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(GOLDEN))


def binary_array(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def held_out_bucket(doc_id: int | None) -> int | None:
    """crc32 of the id as decimal text, mod 5."""
    import zlib

    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5
