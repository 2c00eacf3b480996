"""Helpers of the operators that read whole texts in Arrow batches."""

import contextlib
import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at a time inside a task; one longer text is handled alone.
CHUNK = 2 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, so that their workers can import it and keep
    vocabularies from task to task."""
    context, name = spark.sparkContext, "ledgerline_package.zip"
    if name in context._python_includes:
        return
    package = Path(__file__).resolve().parent.parent
    path = f"{tempfile.mkdtemp(prefix='ledgerline-')}/{name}"  # on the driver, which serves it
    with zipfile.ZipFile(path, "w") as file:
        for module in sorted(package.rglob("*.py")):
            file.write(module, module.relative_to(package.parent))
    context.addPyFile(path)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on from stage to stage, and what it holds adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def mapped(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """`rows` through a function from Arrow batches to Arrow batches."""
    ship(rows.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(task, schema)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold at most `limit` bytes together, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(sizes):
            base = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, base + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts; null counts as empty."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    return pc.fill_null(values, b"").to_pylist()


def joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each text starts and the last one ends."""
    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return np.frombuffer(b"".join(values), np.uint8), offsets


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (finaliser of SplitMix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Numbers(dict):
    """A number for each distinct key, in order of first use: equal numbers mean equal keys."""

    def __missing__(self, key) -> int:
        self[key] = len(self)
        return self[key]


class WordHashes(dict):
    """The 64-bit XXH3 hash of each word, computed once per word that is held."""

    def __missing__(self, word: bytes) -> int:
        self[word] = xxhash.xxh3_64_intdigest(word, 0x5851F42D4C957F2D)
        return self[word]


def coded(lists: list[list[bytes]], codes: dict, kind=np.int64) -> np.ndarray:
    """The code of every word of all lists."""
    return np.fromiter(map(codes.__getitem__, chain.from_iterable(lists)), kind, sum(map(len, lists)))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than blanks) and the number of words of each text."""
    solid = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))
