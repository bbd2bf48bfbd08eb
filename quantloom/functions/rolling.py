"""Rolling moments in Arrow batches: each window's values are taken about their own mean.

Rows are dealt by series and sorted by Spark; a task sees them batch by batch and keeps the last
rows of a series for the windows of the next batch, so it holds a batch whatever a series' length.
Spark's own window adds up a frame anew for each row, some microseconds a value for such moments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructType

from quantloom.functions.expr import EPS
from quantloom.functions.session import dealt

#: Of values (rows, window) and whether each is there, a column's values and whether they are known.
Moments = Callable[[list[np.ndarray], np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


def rolled(df: DataFrame, inputs: list[str], windows: tuple[int, ...], names: list[str], moments: Moments, key: str = "symbol", order: str = "date") -> DataFrame:
    """Adds for each window the columns ``name_w`` that ``moments`` makes of the last w rows of the inputs (double).

    A row where an input is null is not there.
    """
    reach = max(windows) - 1
    schema = StructType([*df.schema.fields])
    for w in windows:
        for name in names:
            schema = schema.add(f"{name}_{w}", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [np.zeros(reach) for _ in inputs]
        there, series, seen = np.zeros(reach, bool), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            runs = pc.run_end_encode(batch.column(key))
            ends, values = np.asarray(runs.run_ends), runs.values.to_pylist()
            starts = np.concatenate([[0], ends[:-1]])
            held = np.zeros(len(starts), np.int64)  # rows of the series in earlier batches
            held[0] = seen if values[0] == series else 0
            place = np.arange(n) - np.repeat(starts - held, np.diff(np.concatenate([starts, [n]])))
            columns = [batch.column(c) for c in inputs]
            known = np.ones(n, bool)
            for c in columns:
                known &= c.is_valid().to_numpy(zero_copy_only=False)
            there = np.concatenate([there, known])
            before = [np.concatenate([b, c.fill_null(0.0).to_numpy(zero_copy_only=False)]) for b, c in zip(before, columns, strict=True)]
            out = []
            for w in windows:
                cut = lambda x: np.lib.stride_tricks.sliding_window_view(x[reach - w + 1 :], w)  # noqa: B023, E731
                mask = cut(there) & (np.arange(w - 1, -1, -1)[None, :] <= place[:, None])
                out += [pa.array(x, pa.float64(), mask=~good) for x, good in moments([cut(b) for b in before], mask)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=schema.names)
            there, before = there[n:], [b[n:] for b in before]
            series, seen = values[-1], int(place[-1]) + 1

    return dealt(df, key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def _centred(x: np.ndarray, mask: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = np.where(mask, x, 0.0).sum(1) / np.maximum(n, 1)
    return mean, np.where(mask, x - mean[:, None], 0.0)


def on_time(values: list[np.ndarray], mask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slope on time, mean and sum of squares about it, of full windows that vary."""
    w = mask.shape[1]
    n = mask.sum(1)
    with np.errstate(invalid="ignore", over="ignore"):
        mean, apart = _centred(values[0], mask, n)
        squares = (apart * apart).sum(1)
        slope = apart @ (np.arange(w) - (w - 1) / 2.0) / (w * (w * w - 1) / 12.0) if w > 1 else np.zeros(len(n))
        good = (n == w) & ~(squares <= EPS)
    return [(slope, good), (mean, good), (squares, good)]


def correlation(values: list[np.ndarray], mask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pearson correlation; unknown without variance or with fewer than half a window's values."""
    n = mask.sum(1)
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        (_, x), (_, y) = (_centred(v, mask, n) for v in values)
        spread = np.sqrt((x * x).sum(1) / np.maximum(n, 1)) * np.sqrt((y * y).sum(1) / np.maximum(n, 1))
        found = (x * y).sum(1) / np.maximum(n, 1) / spread
        good = (n >= max(1, mask.shape[1] // 2)) & ~(spread <= EPS)
    return [(found, good)]
