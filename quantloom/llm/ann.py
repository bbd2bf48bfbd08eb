"""Maximum inner product search with score-aware quantisation and four-bit table scans.

A vector is coded in subspaces of two dimensions with 16 codewords each.  Codewords and
codes minimise the anisotropic loss, in which the part of the residual that is parallel
to the vector weighs more than the rest, because only that part moves the large inner
products.  A scan adds up table entries for pairs of codes; the best of each block, and
those that its error does not set apart from them, are scored again with the original
vectors in double precision.

Every valid row is coded and scanned.  The query set is compared with all rows in blocks:
queries and coded vectors are packed in blocks of bounded size, every vector block meets
every query block, and a task keeps only the running best of its query block, so memory
is bounded and what is emitted is queries times groups of blocks.  Only the codewords are
fitted on a sample, of at most ``SAMPLE`` rows.

Defined cases: vectors that are null, empty, zero, of another than the most frequent
length (ties: the longer) or with null or non-finite components take no part; rows
without vec_id neither, and the table's length decides for queries too; equal scores go to
the smaller vec_id; rows that repeat a vec_id are one another's own; a vec_id that several
query rows have asks once, with the least of its vectors (entry by entry); candidates that
repeat a vec_id are as many rows; with fewer candidates than asked for, all are returned; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows on which the codewords are fitted, at most.
SAMPLE = 10_000
#: Inner products over this share of the norms are those that matter.
THRESHOLD = 0.2
CODES, WIDTH = 16, 2
BLOCK_VECTORS, BLOCK_QUERIES, SCAN_QUERIES = 4096, 8192, 256
#: Of each block, rows that are scored exactly for each query at least.  Beyond them come all
#: whose rough score is within so many standard errors of the k-th best one.
SHORTLIST, ERRORS = 64, 2.0
FIT_ROUNDS, SWEEPS = 6, 2


class Quantiser:
    """Codewords (subspace, code, dimension) fitted to the anisotropic loss."""

    def __init__(self, sample: np.ndarray):
        self.dim = sample.shape[1]
        self.spaces = 2 * ceil(ceil(self.dim / WIDTH) / 2)  # even, as codes are scanned in pairs
        share = THRESHOLD**2
        #: How much more the parallel residual weighs.
        self.weight = max(1.0, (self.dim - 1) * share / (1 - share))
        x = self.cut(sample)
        rng = np.random.default_rng(7)
        picks = rng.choice(len(sample), CODES, replace=len(sample) < CODES)
        self.words = x[picks].transpose(1, 0, 2).copy()
        for _ in range(FIT_ROUNDS):
            self._update(x, self.codes(sample))

    def cut(self, vectors: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(vectors), self.spaces * WIDTH))
        padded[:, : self.dim] = vectors
        return padded.reshape(len(vectors), self.spaces, WIDTH)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Codes of the vectors by coordinate descent on the anisotropic loss."""
        out = np.zeros((len(vectors), self.spaces), np.uint8)
        for low in range(0, len(vectors), 1024):
            x = self.cut(vectors[low : low + 1024])
            apart = x[:, :, None, :] - self.words[None]
            loss = (apart**2).sum(axis=3)
            along = np.einsum("nscd,nsd->nsc", apart, x)
            extra = (self.weight - 1) / np.maximum((x**2).sum(axis=(1, 2)), 1e-300)
            chosen = loss.argmin(axis=2)
            rows = np.arange(len(x))
            total = np.take_along_axis(along, chosen[:, :, None], 2)[:, :, 0].sum(axis=1)
            for _ in range(SWEEPS):
                for s in range(self.spaces):
                    rest = total - along[rows, s, chosen[:, s]]
                    best = (loss[:, s] + extra[:, None] * (rest[:, None] + along[:, s]) ** 2).argmin(axis=1)
                    total = rest + along[rows, s, best]
                    chosen[:, s] = best
            out[low : low + 1024] = chosen
        return out

    def _update(self, x: np.ndarray, codes: np.ndarray) -> None:
        """The codewords that minimise the loss for these codes: one linear system."""
        n, size = len(x), self.spaces * CODES * WIDTH
        at = ((np.arange(self.spaces) * CODES + codes) * WIDTH)[:, :, None] + np.arange(WIDTH)
        left, right = np.zeros((size, size)), np.zeros(size)
        for low in range(0, n, 2000):
            part, where = x[low : low + 2000], at[low : low + 2000].reshape(-1, self.spaces * WIDTH)
            flat = part.reshape(len(part), -1)
            unit = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)
            spread = np.zeros((len(part), size))
            np.put_along_axis(spread, where, unit, 1)
            left += (self.weight - 1) * spread.T @ spread
            np.add.at(right, where, self.weight * flat)
            left[np.diag_indices(size)] += np.bincount(where.ravel(), minlength=size)
        used = np.bincount((at // WIDTH)[:, :, 0].ravel(), minlength=size // WIDTH) > 0
        solved = np.linalg.solve(left + 1e-6 * np.eye(size), right).reshape(self.spaces, CODES, WIDTH)
        used = used.reshape(self.spaces, CODES)
        self.words[used] = solved[used]

    def error(self, vectors: np.ndarray, packed: np.ndarray) -> float:
        """Standard error of rough scores for a query of norm 1: what codes leave of the vectors, by dimension."""
        codes = np.empty((len(packed), self.spaces), np.int64)
        codes[:, 0::2], codes[:, 1::2] = packed >> 4, packed & 15
        back = self.words[np.arange(self.spaces), codes].reshape(len(codes), -1)[:, : self.dim]
        return float(np.sqrt(((vectors - back) ** 2).mean())) if len(vectors) else 0.0

    def pack(self, vectors: np.ndarray) -> np.ndarray:
        """Two four-bit codes in a byte."""
        codes = self.codes(vectors)
        return codes[:, 0::2] << np.uint8(4) | codes[:, 1::2]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each pair of subspaces, each byte and each query what it adds to the score."""
        one = np.einsum("qsd,scd->sqc", self.cut(queries), self.words).astype(np.float32)
        return (one[0::2, :, :, None] + one[1::2, :, None, :]).reshape(self.spaces // 2, len(queries), CODES * CODES)


def valid_rows(table: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and its vector as doubles, of any length, of the rows that have a usable one."""
    values = F.col(vector).cast("array<double>")
    rows = table.select(F.col(key).cast("long").alias("vec_id"), values.alias("vector")).where("vec_id IS NOT NULL AND size(vector) > 0")
    good = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists("vector", lambda x: x != 0)
    return rows.where(good)


def valid_vectors(table: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Those of valid_rows() that take part: of the table's most frequent length."""
    rows = valid_rows(table, vector, key)
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (usual["n"] if usual else 0))


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Quantiser | None:
    """Fitted on the ``sample`` rows whose vec_id hashes lowest."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow().column("vector")
    if not len(rows):
        return None
    return Quantiser(np.asarray(rows.combine_chunks().flatten()).reshape(len(rows), -1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row: by score, then by the smaller id."""
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], score[keep], ids[keep]


def scan(quantiser: Quantiser, queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray, k: int, shortlist: int):
    """The k best of a block for each query: table scan, then exact scores."""
    out = []
    shortlist = max(shortlist, 2 * k)
    error = quantiser.error(vectors, codes)
    for low in range(0, len(queries), SCAN_QUERIES):
        part = queries[low : low + SCAN_QUERIES]
        tables = quantiser.tables(part)
        rough = np.zeros((len(part), len(vectors)), np.float32)
        for table, column in zip(tables, codes.T, strict=True):
            rough += table.take(column, axis=1)
        rough[own[low : low + SCAN_QUERIES, None] == ids[None]] = -np.inf
        if rough.shape[1] > shortlist:
            ends = np.partition(rough, (-shortlist, -k), axis=1)
            near = ends[:, -k] - np.float32(ERRORS * error) * np.linalg.norm(part, axis=1).astype(np.float32)
            bound = np.minimum(ends[:, -shortlist], near)
            row, at = np.nonzero(rough >= bound[:, None])
        else:
            row, at = np.nonzero(rough > -np.inf)
        keep = ids[at] != own[low + row]
        row, at = row[keep], at[keep]
        score = np.concatenate([(vectors[at[i : i + 65536]] * part[row[i : i + 65536]]).sum(axis=1) for i in range(0, len(at), 65536)] or [np.zeros(0)])
        row, score, found = _best(row, score, ids[at], k)
        out.append((row + low, score, found))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(
    table: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding", key: str = "vec_id", sample: int = SAMPLE, shortlist: int = SHORTLIST, block: int = BLOCK_VECTORS
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k nearest rows of ``table``."""
    spark = table.sparkSession
    vectors = valid_vectors(table, vector, key)
    quantiser = fit(vectors, sample)
    schema = "query_id long, vec_id long, score double"
    if quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(quantiser)
    dim = quantiser.dim
    # An id asks once, however many rows have it.
    asked = valid_rows(queries, vector, key).where(F.size("vector") == dim).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    groups = max(1, ceil(asked.count() / BLOCK_QUERIES))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = max(1, ceil(2 * tasks / groups))

    def pack_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                ids, values = part.column(0).to_numpy(), _matrix(part.column(1))
                blobs = [ids.tobytes(), shared.value.pack(values).tobytes(), values.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), *(pa.array([x], pa.binary()) for x in blobs)], names=["at", "ids", "codes", "vectors"])

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def one(group: int) -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*held.pop(group), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["q", "own", "queries"])

        for batch in batches:
            group, ids, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            for g in np.unique(group).tolist():
                mine = group == g
                held.setdefault(g, []).append((ids[mine], values[mine]))
                if sum(len(x) for x, _ in held[g]) >= BLOCK_QUERIES:
                    yield one(g)
        for g in list(held):
            yield one(g)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, tuple] = {}  # the running best of the query blocks of this task's groups
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["own"], np.int64)
                ids = np.frombuffer(row["ids"], np.int64)
                asked_of, values = (np.frombuffer(row[x], np.float64).reshape(-1, dim) for x in ("queries", "vectors"))
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                at, score, found = scan(shared.value, asked_of, own, values, ids, codes, k, shortlist)
                name = (row["q"], int(own[0]), len(own))
                if name in state:
                    _, *before = state[name]
                    at, score, found = _best(*(np.concatenate(x) for x in zip(before, (at, score, found), strict=True)), k)
                elif len(state) >= 8:
                    yield from (one(*x) for x in state.values())
                    state.clear()
                state[name] = (own, at, score, found)
        yield from (one(*x) for x in state.values())

    def one(own, at, score, found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    packed = vectors.mapInArrow(pack_vectors, "at long, ids binary, codes binary, vectors binary")
    packed = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("q"), F.pmod(F.xxhash64("at"), F.lit(spread)).alias("v"))
    asked = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("q"), "vec_id", "vector").repartition(min(groups, tasks), "q")
    asked = asked.mapInArrow(pack_queries, "q int, own binary, queries binary").select("*", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("v"))
    # Sized by work, not by bytes: each of these block pairs costs far more than reading it.
    parts = max(tasks, min(groups * spread, 4 * tasks))
    both = packed.repartition(parts, "q", "v").join(asked.repartition(parts, "q", "v").hint("merge"), ["q", "v"])
    found = both.select("q", "own", "queries", "ids", "codes", "vectors").mapInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
