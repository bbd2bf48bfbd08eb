"""What the operators share: a shared scratch folder and byte-level word hashing.

Hashes are 64-bit polynomials over random byte values, computed for a whole Arrow
batch at once with NumPy prefix sums, so the cost is a few nanoseconds a byte and
a word's hash does not depend on where it stands.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- scratch


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Only in local mode (tests on one machine) a temporary folder takes its place; on a
    cluster, where tasks would not find each other's files in one, its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quantloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session's Python tasks by bytes, unless it has them smaller.

    By default they hold up to 64 MB of texts, several times over in the task and its worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = (spark.conf.get(key, None) or "").rstrip("bB")
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_scopes: list[list[Scratch]] = []


@contextmanager
def discarding() -> Iterator[None]:
    """Deletes at its end the tables that operators have written inside: what has been made of
    their lazy results inside stays, if it was written."""
    _scopes.append([])
    try:
        yield
    finally:
        for scratch in _scopes.pop():
            scratch._clean()


@contextmanager
def _short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete an execution's shuffle files at its end; else they stay until the driver
    collects garbage.  A write plans anew, so no later execution reads those files."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class Scratch:
    """Tables that an operator writes to the shared folder to cut its lineage.

    A lost executor then costs a re-read, never a recomputation from the start.
    Tables stay readable until the session ends, because returned DataFrames are
    lazy; ``drop`` removes one that has been superseded.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        if _scopes:
            _scopes[-1].append(self)
        self.root = f"{shared_dir(spark)}/quantloom/{name}-{uuid.uuid4().hex}"
        atexit.register(self._clean)

    def _clean(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                drop_path(self.spark, self.root)
        except Exception:  # the JVM may be gone at interpreter exit
            pass

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The table once it is written; what the write itself has shuffled is deleted then."""
        path = f"{self.root}/{name}"
        with _short_lived_shuffles(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        drop_path(self.spark, f"{self.root}/{name}")


def text_bytes(column: str = "text"):
    """A string column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


# --------------------------------------------------------------------------- packing


def packed(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane, so that bytes that hardly differ lie together, and compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


# --------------------------------------------------------------------------- hashing

#: ASCII white space: tab, line feed, vertical tab, form feed, carriage return, space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Text bytes that one vectorised step holds; its temporaries take about 40 times this.
STEP_BYTES = 1 << 18
#: Bytes that a task and its Python worker exchange at a time, about.
BATCH_BYTES = 2 << 20
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the public splitmix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = -(-n // STEP_BYTES) * STEP_BYTES
        both = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers = (both[0], both[1])
    return _powers


class Texts:
    """Some rows' texts as one byte array, with the rows' bounds."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first_row: int):
        self.data, self.bounds, self.first_row = data, bounds, first_row
        self.rows = len(bounds) - 1
        self._prefix: np.ndarray | None = None

    def lower(self) -> Texts:
        return Texts(LOWER[self.data], self.bounds, self.first_row)

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte spans."""
        up, down = powers(len(self.data) + 1)
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(BYTE_VALUE[self.data] * up[: len(self.data)], out=self._prefix[1:])
        return mix((self._prefix[ends] - self._prefix[starts]) * down[starts])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for each row the range of its words."""
        return self.runs(~SPACE[self.data])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As words(), of the maximal runs where ``inside`` holds, cut at row bounds."""
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.rows + 1, np.int64)
        cut = np.zeros(len(inside) + 1, bool)
        cut[self.bounds] = True
        before = np.ones(len(inside), bool)
        before[1:] = ~inside[:-1]
        after = np.ones(len(inside), bool)
        after[:-1] = ~inside[1:]
        starts = np.flatnonzero(inside & (before | cut[:-1]))
        ends = np.flatnonzero(inside & (after | cut[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def sums(self, of: np.ndarray) -> np.ndarray:
        """For each row the sum of ``of`` over its bytes."""
        total = np.zeros(len(of) + 1, np.int64)
        np.cumsum(of, out=total[1:])
        return np.diff(total[self.bounds])


def steps(column: pa.Array | pa.ChunkedArray, limit: int | None = None) -> Iterator[Texts]:
    """The rows of a binary column in groups of about ``limit`` bytes (one row at least)."""
    limit = limit or STEP_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        own = bounds[row : end + 1]
        yield Texts(every[own[0] : own[-1]], own - own[0], row)
        row = end


_WINDOW_BASE = 0xD6E8FEB86659FD93


def windows(hashes: np.ndarray, ranges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each row: (first word, row, hash)."""
    if len(hashes) < n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    counts = np.diff(ranges)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.flatnonzero(np.arange(len(hashes)) + n <= ranges[1:][row])
    total = np.zeros(len(first), np.uint64)
    factor = 1
    for i in range(n):
        total += hashes[first + i] * np.uint64(factor)
        factor = factor * _WINDOW_BASE % (1 << 64)
    return first, row[first], mix(total)


def in_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows, for finding repeats within a row."""
    return hashes ^ mix((rows.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64) if hashes.flags.c_contiguous else np.ascontiguousarray(hashes).view(np.int64)
