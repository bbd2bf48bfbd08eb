"""Column expressions that the operators share: guarded ratios, rolling frames, ranks.

Spark runs in ANSI mode, so a plain division by zero fails; every ratio goes through one
of the helpers here.  Rolling helpers count the values in the frame that are not null and
give null below ``least`` of them.
"""

from __future__ import annotations

from functools import reduce
from math import log1p
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def over_floor(top: str | Column, bottom: str | Column, eps: float = EPS) -> Column:
    """top / max(bottom, eps); null for null."""
    bottom = col(bottom)
    return F.when(bottom.isNotNull(), col(top) / F.greatest(bottom, F.lit(eps)))


def over_shifted(top: str | Column, bottom: str | Column, eps: float = EPS) -> Column:
    """top / (bottom + eps), for bottoms that are not negative."""
    return col(top) / (col(bottom) + F.lit(eps))


def guarded(top: str | Column, bottom: str | Column, eps: float = EPS) -> Column:
    """top / bottom where bottom is above eps, else null."""
    return F.when(col(bottom) > eps, col(top) / col(bottom))


def finite(x: str | Column) -> Column:
    """Null for NaN and infinities."""
    x = col(x)
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)


def by_date(*keys: str) -> WindowSpec:
    """A series of its own for each key, in order of date."""
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("date")


def frame(w: int, series: WindowSpec | None = None) -> WindowSpec:
    """The last w rows of the series, this one included."""
    return (series if series is not None else by_date()).rowsBetween(-(w - 1), 0)


def rolling(agg, x: str | Column, w: int, least: int | None = None, series: WindowSpec | None = None) -> Column:
    """``agg`` of x over the last w rows; null below ``least`` values (w // 2 without it)."""
    f, x = frame(w, series), col(x)
    return F.when(F.count(x).over(f) >= max(1, w // 2 if least is None else least), agg(x).over(f))


def shifted(x: str | Column, n: int = 1, series: WindowSpec | None = None) -> Column:
    """The value n rows before (after, if n is negative)."""
    series = series if series is not None else by_date()
    return F.lag(col(x), n).over(series) if n >= 0 else F.lead(col(x), -n).over(series)


#: Values of a block in ``with_emas``.
BLOCK = 64


def with_emas(df: DataFrame, means: dict[str, tuple[str, int]], key: str = "symbol", order: str = "date") -> DataFrame:
    """Adds exponential means: name -> (column, span), with weight 2 / (span + 1) and started at
    the first value that is not null; a row without a value has the mean before it.

    A series is cut in blocks of 64 values.  Inside a block the mean is a running sum of values
    that are scaled up by their place; what came before enters as the sums of earlier blocks,
    as many as weigh more than 1e-17.  So a row costs the same whatever the span.
    """
    series = Window.partitionBy(key).orderBy(order)
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for x in dict.fromkeys(x for x, _ in means.values()):
        mine = {name: 2.0 / (span + 1) for name, (y, span) in means.items() if y == x}
        df = df.withColumn("_nth", F.count(x).over(series.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        df = df.withColumns({"_block": F.floor(F.col("_nth") / BLOCK), "_at": F.col("_nth") % BLOCK})
        share = lambda a: F.when(F.col("_nth") == 0, 1.0).otherwise(a)
        df = df.withColumns({f"_t_{n}": F.col(x) * share(a) * F.pow(F.lit(1 - a), -F.col("_at")) for n, a in mine.items()})
        df = df.withColumns({f"_i_{n}": F.sum(f"_t_{n}").over(inside) for n in mine})
        blocks = Window.partitionBy(key).orderBy("_block")
        for n, a in mine.items():
            depth = int(40 / -log1p(-a)) // BLOCK + 1
            before = [F.coalesce(F.sum(f"_t_{n}").over(blocks.rangeBetween(-i, -i)), F.lit(0.0)) * (1 - a) ** (BLOCK * i) for i in range(1, depth + 1)]
            total = reduce(add, before, F.coalesce(F.col(f"_i_{n}"), F.lit(0.0)))
            df = df.withColumn(n, F.when(F.col("_nth") >= 0, total * F.pow(F.lit(1 - a), F.col("_at"))))
        df = df.drop("_nth", "_block", "_at", *(f"_{k}_{n}" for k in "ti" for n in mine))
    return df


def sorted_frame(x: str | Column, w: int) -> Column:
    """The values of the last w rows that are not null, ascending."""
    return F.sort_array(F.collect_list(col(x)).over(frame(w)))


def quantile_of(values: str | Column, share: float, least: int = 1) -> Column:
    """Interpolated quantile of a sorted array; null below ``least`` values."""
    values = col(values)
    n = F.size(values)
    place = (n - 1) * F.lit(share)
    low = F.floor(place).cast("int")
    a, b = F.get(values, low), F.get(values, F.ceil(place).cast("int"))
    return F.when(n >= max(1, least), a + (b - a) * (place - low))


def pct_rank(x: str | Column, *keys: str) -> Column:
    """Rank of x among its group's values as a share, ties at their mean; null for null.  All from one sort."""
    x = col(x)
    group = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    upto = F.count(x).over(group.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.count(x).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(x.isNotNull(), (F.rank().over(group) + upto) / 2.0 / whole)


def clamp(x: str | Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))
