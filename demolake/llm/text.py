"""Word splitting and hashing of whole Arrow batches with numpy.

The operators run these helpers inside ``mapInArrow`` tasks; Spark decides the
partitions. All hashes are fixed functions of the bytes, so that tasks that are
run again give the same rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every ASCII byte that is no digit and no letter into a space; all bytes from 0x80 stay.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Keeps letters only (bytes from 0x80 count as letters).
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 2**64))
    up, down = np.full(n + 1, _ODD, dtype=np.uint64), np.full(n + 1, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(1 << 16)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least up to the n-th."""
    global _UP, _DOWN
    if n >= len(_UP):
        _UP, _DOWN = _powers(max(n, 2 * len(_UP)))
    return _UP, _DOWN


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:end]`` for many ranges at once, by prefix sums."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and each text's first word in a buffer of texts.

    ``data`` holds the bytes of all texts, text i being ``data[bounds[i]:bounds[i+1]]``;
    words are maximal runs without white space and never cross texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[bounds[:-1]] = True  # a text that starts here ends the word before it
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    ends = np.zeros(n, dtype=bool)
    ends[:-1] = solid[:-1] & (~solid[1:] | first[1:n])
    ends[-1] = solid[-1]
    starts = np.nonzero(begins)[0]
    return starts, np.nonzero(ends)[0] + 1, np.searchsorted(starts, bounds)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the bounds of its texts (null: empty), without a copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]] if len(bounds) else data[:0], bounds - (bounds[0] if len(bounds) else 0)


def pieces(batch: pa.RecordBatch, at: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes, so that memory doesn't follow the batch; a longer text stands alone."""
    _, bounds = text_buffer(batch.column(at))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def releasing(f):
    """A mapInArrow function that gives its memory back at the end: Python workers live on and serve later stages."""

    @functools.wraps(f)
    def run(batches):
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Bounds the Arrow batches between JVM and Python by rows and bytes, unless the session has its own bounds.

    Texts are long rows: the default of 10,000 rows a batch holds several copies of as many texts.
    """
    for key, value, default in (("maxRecordsPerBatch", rows, "10000"), ("maxBytesPerBatch", size, None)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is None or now == default or (default is None and name not in dict(spark.sparkContext.getConf().getAll())):
            spark.conf.set(name, str(value))


def word_counts(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """How often each lower-case run of letters stands in all texts, by ``keys``: columns keys, word, n.

    Counted within each task first, then summed.
    """
    small_batches(df.sparkSession)
    schema = df.select(*keys).schema.simpleString()[7:-1]
    schema = ", ".join(x for x in (schema.replace(":", " "), "word binary", "n long") if x)

    @releasing
    def count(batches):
        counts: dict[tuple, Counter] = {}

        def flush():
            for key, c in counts.items():
                words = list(c)
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(words), t) for k, t in zip(key, types, strict=True)), pa.array(words, pa.binary()), pa.array(list(c.values()), pa.int64())], names=[*keys, "word", "n"])
            counts.clear()

        types = []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            for key, t in zip(zip(*columns, strict=True) if keys else iter(lambda: (), None), batch.column(batch.schema.get_field_index(text)).to_pylist(), strict=bool(keys)):
                if t:
                    counts.setdefault(key, Counter()).update(t.lower().encode("utf-8", "replace").translate(LETTERS).split())
            if sum(map(len, counts.values())) > 400_000:
                yield from flush()
        yield from flush()

    return df.select(*keys, text).mapInArrow(count, schema).groupBy(*keys, "word").agg(F.sum("n").alias("n"))
