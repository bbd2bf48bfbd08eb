"""Bounds of each date from the values up to it, by quantile sketches that are merged in prefixes.

A sketch counts a column's values in buckets whose ends are in a fixed ratio, so sketches
merge by adding counts, in any order, with the same result.  Rows are only read to count
them by (date, bucket), before any shuffle.  Prefixes have two levels: blocks of dates are
added up first, each block then starts from the sum of all earlier ones and walks through
its own dates, so blocks are independent tasks that hold one sketch each.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a value by which a bound may be off, and the magnitude below which values count as 0.
ERROR, TINY = 0.002, 1e-12
BLOCK_DAYS = 366
#: Largest double's logarithm, for the number of buckets.
_LARGEST = 709.8
_SEED = -(1 << 40)


def _step(error: float) -> float:
    """The logarithm of a bucket's upper end over its lower end."""
    return log((1 + error) / (1 - error))


def _first(error: float) -> int:
    """What is added to a logarithm's bucket, so that the least one is 1."""
    return 1 - ceil(log(TINY) / _step(error))


def bucket(value: Column, error: float = ERROR) -> Column:
    """The bucket of a finite value: its order is that of the values, 0 holds those around 0."""
    place = F.ceil(F.log(F.abs(value)) / F.lit(_step(error))) + F.lit(_first(error))
    return F.when(F.abs(value) < TINY, 0).otherwise(F.signum(value).cast("long") * place).cast("long")


def _value(buckets: np.ndarray, error: float) -> np.ndarray:
    """A value that lies within the error of all values of its bucket."""
    magnitude = np.exp((np.abs(buckets) - _first(error)) * _step(error)) * (1 - error)
    return np.where(buckets == 0, 0.0, np.sign(buckets) * magnitude)


def _bounds(shares: tuple[float, float], error: float):
    """Turns rows (column, block, day, bucket, n), sorted by the first three, into a row a column and day."""
    middle = _first(error) + ceil(_LARGEST / _step(error)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, low, high, now = np.zeros(2 * middle + 1, np.int64), middle, middle, None

        def said() -> list[tuple[int, int, int, int]]:
            if now is None or now[2] == _SEED:
                return []
            upto = np.cumsum(held[low : high + 1])
            places = np.floor(np.array(shares) * (upto[-1] - 1))
            return [(now[0], now[2], *(np.searchsorted(upto, places, "right") + low - middle).tolist())]

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not batch.num_rows:
                continue
            keys = np.stack(rows[:3], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            found = []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
                key = tuple(keys[start].tolist())
                if key != now:
                    found += said()
                    if now is None or key[:2] != now[:2]:
                        held[low : high + 1] = 0
                        low = high = middle
                    now = key
                at = rows[3][start:end] + middle
                np.add.at(held, at, rows[4][start:end])
                low, high = min(low, int(at.min())), max(high, int(at.max()))
            yield _batch(found, error)
        yield _batch(said(), error)

    return run


def _batch(found: list[tuple[int, int, int, int]], error: float) -> pa.RecordBatch:
    rows = np.array(found, np.int64).reshape(-1, 4)
    columns = [pa.array(rows[:, 0]), pa.array(rows[:, 1]), *(pa.array(_value(rows[:, i], error)) for i in (2, 3))]
    return pa.RecordBatch.from_arrays(columns, names=["column", "day", "low", "high"])


def bounds_to_date(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, error: float = ERROR, block_days: int = BLOCK_DAYS) -> DataFrame:
    """column (its place), day (since 1970), low, high: lower quantiles of the values up to that day.

    Each bound is within ``error`` of the exact order statistic, as a share of it (1e-12 near 0).
    Nulls and values that are not finite are not counted; days without any have no row.
    """
    rows = df.select(F.unix_date(F.col("date").cast("date")).cast("long").alias("day"), F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("column", "value"))
    rows = rows.where("day IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")
    rows = rows.select(F.col("column").cast("long"), F.floor(F.col("day") / block_days).alias("block"), "day", bucket(F.col("value"), error).alias("bucket"))
    counts = rows.groupBy("column", "block", "day", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # A row a column, block and bucket; every later block starts from them.
    totals = counts.groupBy("column", "block", "bucket").agg(F.sum("n").alias("n"))
    later = totals.select("column", F.col("block").alias("to")).distinct()
    seeds = totals.join(later, "column").where("block < to").groupBy("column", "to", "bucket").agg(F.sum("n").alias("n"))
    seeds = seeds.select("column", F.col("to").alias("block"), F.lit(_SEED).cast("long").alias("day"), "bucket", "n")
    walked = counts.unionByName(seeds).repartition("column", "block").sortWithinPartitions("column", "block", "day")
    return walked.mapInArrow(_bounds((low, high), error), "column long, day long, low double, high double")


def winsorize_to_date(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, error: float = ERROR, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Clips each column to its quantiles over all rows up to the row's date, that date included.

    Later rows never change an earlier row's bounds.  Nulls and NaN stay, infinities take the
    bound; without a date, or on one on which a column has no finite value, nothing is clipped.
    Bounds 0 and 1 do nothing.
    """
    if (low <= 0 and high >= 1) or not columns:
        return df
    mark = "_"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    found = bounds_to_date(df, columns, low, high, error, block_days)
    own = {f"{mark}{side}_{i}": F.max(F.when(F.col("column") == i, F.col(side))) for i in range(len(columns)) for side in ("low", "high")}
    wide = found.groupBy(F.date_from_unix_date(F.col("day").cast("int")).alias(f"{mark}day")).agg(*(x.alias(name) for name, x in own.items()))
    clipped = {c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.col(c)).otherwise(F.greatest(f"{mark}low_{i}", F.least(f"{mark}high_{i}", c))) for i, c in enumerate(columns)}
    joined = df.join(wide, F.col("date").cast("date") == F.col(f"{mark}day"), "left")  # a row a date
    return joined.withColumns(clipped).select(df.columns)
