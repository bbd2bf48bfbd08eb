"""Filters on a market's cross-section, diversified picks, and the backtest of predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import EPS
from quantloom.functions.session import running_total

YEAR = 252


def latest(df: DataFrame, by: str = "market") -> DataFrame:
    """The rows of each market's last date."""
    last = df.groupBy(by).agg(F.max("date").alias("_last")).withColumnRenamed(by, "_by")
    last = F.broadcast(last) if by == "market" else last  # a row a market; other keys may be many
    return df.join(last, (F.col(by) == F.col("_by")) & (F.col("date") == F.col("_last"))).drop("_by", "_last")


def name_allowed(pattern: str = "ST|退|暂停") -> Column:
    return ~F.coalesce(F.col("name").rlike(pattern), F.lit(False))


def within_limit() -> Column:
    """The move is inside the market's price limit; unknown moves and limits pass."""
    return F.coalesce(F.abs("pct_chg") <= F.col("price_limit") * 0.995, F.lit(True))


def not_limit_up(share: float = 0.0995) -> Column:
    return F.coalesce(~((F.col("market") == "CN") & (F.abs("pct_chg") > share)), F.lit(True))


def liquid(least: float = 0.3) -> Column:
    return F.coalesce(F.col("volume_ratio_5") >= least, F.lit(True))


def enough_amount() -> Column:
    return F.coalesce(F.col("amount") >= F.col("min_amount"), F.lit(True))


def with_history(df: DataFrame) -> DataFrame:
    """Adds n_bars, counted over the symbol's whole history."""
    return df.withColumn("n_bars", F.count(F.lit(1)).over(Window.partitionBy("symbol")))


def _rules(least_bars: int) -> dict[str, Column]:
    """The rules in their order, by name."""
    named = name_allowed() | ~F.coalesce(F.col("st_filter"), F.lit(False))
    return {"name": named, "history": F.col("n_bars") >= least_bars, "price_limit": within_limit(), "limit_up": not_limit_up(), "liquidity": liquid(), "amount": enough_amount()}


def _latest_with_rules(panel: DataFrame, rules: DataFrame) -> DataFrame:
    return latest(with_history(panel)).join(F.broadcast(rules), "market", "left")  # a row a market


def filter_market(panel: DataFrame, rules: DataFrame, least_bars: int = 60) -> DataFrame:
    """Latest rows that pass all rules of their market, in one predicate."""
    rows = _latest_with_rules(panel, rules)
    return rows.where(reduce(Column.__and__, _rules(least_bars).values())).drop(*(c for c in rules.columns if c != "market"))


def filter_audit(panel: DataFrame, rules: DataFrame, least_bars: int = 60) -> DataFrame:
    """market, step, rule, before, after: how many rows each rule of ``filter_market`` leaves, by one aggregate."""
    tests = _rules(least_bars)
    passed, so_far = [F.count(F.lit(1)).alias("_0")], F.lit(True)
    for i, test in enumerate(tests.values(), 1):
        so_far = so_far & test
        passed.append(F.count(F.when(so_far, 1)).alias(f"_{i}"))
    counts = _latest_with_rules(panel, rules).groupBy("market").agg(*passed)
    steps = [F.struct(F.lit(i).alias("step"), F.lit(name).alias("rule"), F.col(f"_{i - 1}").alias("before"), F.col(f"_{i}").alias("after")) for i, name in enumerate(tests, 1)]
    return counts.select("market", F.inline(F.array(*steps)))


# The symbols of a market whose constituents are not known.
PRESETS = {
    "US": ["AAPL", "MSFT", "GOOGL", "AMZN", "NVDA", "TSLA", "META", "AVGO", "JPM", "V"],
    "KR": ["005930.KS", "000660.KS", "035420.KQ", "091990.KQ"],
    "JP": ["7203.T", "9984.T", "6758.T", "9432.T"],
    "CN": ["600519.SS", "000858.SZ", "300750.SZ", "601318.SS", "000333.SZ", "600036.SS", "002415.SZ", "688981.SS"],
}


def universe(constituents: DataFrame, market: str, most: int = 500) -> DataFrame:
    """market, code: the first constituents of an index for CN, the preset for others or where there are none."""
    preset = constituents.sparkSession.createDataFrame([(c,) for c in PRESETS.get(market, [])], "code string")
    codes = preset
    if market == "CN":
        found = constituents.where("code IS NOT NULL").select("code").orderBy("code").limit(most)
        none = found.agg(F.count(F.lit(1)).alias("_n"))
        codes = found.unionByName(preset.crossJoin(F.broadcast(none)).where("_n = 0").drop("_n"))  # one row
    return codes.select(F.lit(market).alias("market"), "code")


def diversified(rows: DataFrame, k: int = 10, cap: int | None = 2) -> DataFrame:
    """The k best of each market with at most ``cap`` of an industry, with their rank."""
    best = [F.desc("pred_ret"), "symbol"]
    if cap is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("market", "industry").orderBy(*best))).where(F.col("_n") <= cap).drop("_n")
    order = Window.partitionBy("market").orderBy(*best)
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def pick_metrics(rows: DataFrame, k: int = 10) -> DataFrame:
    picks = rows.orderBy(F.desc("pred_ret"), "symbol").limit(k)
    x = F.col("pred_ret")
    return picks.agg(F.count(x).alias("n"), F.avg(x).alias("avg_pred"), F.max(x).alias("max_pred"), F.min(x).alias("min_pred"), F.stddev_samp(x).alias("std_pred"))


def quantile_groups(predictions: DataFrame, groups: int = 5) -> DataFrame:
    """Adds grp: Q1 for the lowest predictions.  Ranks are global and ties keep their order."""
    ranked = running_total(predictions, ["pred_ret", "date", "symbol"], name="_before")
    total = predictions.agg(F.count(F.lit(1)).alias("_n"))
    place = F.greatest(F.lit(1), F.ceil(F.col("_before") * groups / F.greatest(F.col("_n") - 1, F.lit(1))))
    ranked = ranked.crossJoin(F.broadcast(total)).where(F.col("_n") >= 2 * groups)  # one row
    return ranked.withColumn("grp", F.concat(F.lit("Q"), place.cast("int").cast("string"))).drop("_before", "_n")


def quintiles(predictions: DataFrame, groups: int = 5) -> DataFrame:
    hit = F.when(F.col("label") > 0, 1.0).otherwise(0.0)
    return quantile_groups(predictions, groups).groupBy("grp").agg(
        F.avg("pred_ret").alias("mean_pred"), F.avg("label").alias("mean_label"), F.stddev_samp("label").alias("std_label"), F.count("label").alias("n"), F.avg(hit).alias("hit_rate")
    )


def long_short(table: DataFrame, long_leg: str = "Q1", short_leg: str = "Q5") -> DataFrame:
    """Spread of mean labels between two groups of ``quintiles``, with Welch's t."""
    of = lambda c, leg: F.max(F.when(F.col("grp") == leg, F.col(c)))
    sides = table.agg(*(of(c, leg).alias(f"{c}_{side}") for side, leg in (("a", long_leg), ("b", short_leg)) for c in ("mean_label", "std_label", "n")))
    spread = F.col("mean_label_a") - F.col("mean_label_b")
    error = F.sqrt(F.col("std_label_a") ** 2 / F.col("n_a") + F.col("std_label_b") ** 2 / F.col("n_b"))
    return sides.select(spread.alias("spread"), F.when(error > EPS, spread / error).otherwise(0.0).alias("t_stat"))


def topk_daily(predictions: DataFrame, ks: tuple[int, ...] = (10,)) -> DataFrame:
    """top_k, date, ret, n: equal-weight return of each date's k best, if at least half are there.

    One window serves all k; rows beyond the largest are cut before the shuffle.
    """
    best = Window.partitionBy("date").orderBy(F.desc("pred_ret"), "symbol")
    ranked = predictions.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= max(ks))
    each = ranked.withColumn("top_k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("_rank"))))
    daily = each.groupBy("top_k", "date").agg(F.avg("label").alias("ret"), F.count("label").alias("n"))
    return daily.where(F.col("n") >= F.floor(F.col("top_k") / 2))


def cumulative(daily: DataFrame) -> DataFrame:
    so_far = Window.partitionBy("top_k").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cum", F.product(1 + F.col("ret")).over(so_far))


def sharpe(mean: Column, spread: Column, n: Column) -> Column:
    return F.when((n >= 5) & (spread >= 1e-10), F.sqrt(F.lit(float(YEAR))) * mean / spread).otherwise(0.0)


def backtest(predictions: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 30)) -> DataFrame:
    """A row for each k: Sharpe ratio, final value, days, mean daily return."""
    daily = topk_daily(predictions, ks)
    sums = daily.groupBy("top_k").agg(
        F.avg("ret").alias("avg_daily_ret"), F.stddev_samp("ret").alias("_sd"), F.count("ret").alias("n_days"), F.product(1 + F.col("ret")).alias("final_cum")
    )
    return sums.select("top_k", sharpe(F.col("avg_daily_ret"), F.col("_sd"), F.col("n_days")).alias("sharpe"), "final_cum", "n_days", "avg_daily_ret")
