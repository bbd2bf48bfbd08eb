"""The sentiment timeline and the trading flow's rules on it.

Nothing reads the clock: every operator that needs the present takes ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETENTION_HOURS = 72
SLOTS = {"0700": (420, 435), "0925": (565, 580), "1330": (810, 825), "0955": (595, 605)}
#: Slots with the local hour after which a missing run counts as missed.
SLOT_HOURS = (("0700", 7), ("0925", 9), ("0955", 9), ("1330", 13))


def _now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def local_time(ts: Column) -> Column:
    """Wall clock eight hours ahead of UTC."""
    return ts + F.expr("INTERVAL 8 HOURS")


def hour_dedup(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each hour and market, by a partial aggregate."""
    columns = [c for c in snapshots.columns if c != "market"]
    kept = snapshots.groupBy(F.date_trunc("hour", "timestamp").alias("_hour"), "market").agg(F.max_by(F.struct(*columns), F.struct("timestamp", "seq")).alias("_row"))
    return kept.select("market", "_row.*").select(snapshots.columns)


def recent(snapshots: DataFrame, as_of: str, hours: int = RETENTION_HOURS) -> DataFrame:
    return snapshots.where(F.col("timestamp") >= _now(as_of) - F.expr(f"INTERVAL {hours} HOURS"))


def gaps(snapshots: DataFrame, hours: float = 1.5) -> DataFrame:
    series = Window.partitionBy("market").orderBy("timestamp", "seq")
    before = F.lag("timestamp").over(series)
    rows = snapshots.select("market", before.alias("gap_start"), F.col("timestamp").alias("gap_end"))
    return rows.withColumn("gap_hours", (F.unix_micros("gap_end") - F.unix_micros("gap_start")) / 3.6e9).where(F.col("gap_hours") > hours)


def curve(snapshots: DataFrame) -> DataFrame:
    """Adds smooth (three points, zeros beyond the ends), trend and volatility."""
    series = Window.partitionBy("market").orderBy("timestamp", "seq")
    x, whole = F.col("sentiment_score"), Window.partitionBy("market")
    smooth = (F.coalesce(F.lag(x).over(series), F.lit(0.0)) + x + F.coalesce(F.lead(x).over(series), F.lit(0.0))) / 3
    last5 = series.rowsBetween(-4, 0)
    return snapshots.withColumns(
        {
            "smooth": F.when(F.count(x).over(whole) >= 3, smooth).otherwise(x),
            "trend": F.coalesce(x - F.lag(x).over(series), F.lit(0.0)),
            "volatility": F.coalesce(F.when(F.count(x).over(last5) >= 2, F.stddev_samp(x).over(last5)), F.lit(0.0)),
        }
    )


def curve_snapshot(snapshots: DataFrame) -> DataFrame:
    x, at = F.col("sentiment_score"), F.struct("timestamp", "seq")
    return snapshots.groupBy("market").agg(
        F.max_by(x, at).alias("last"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        (F.max_by(x, at) - F.min_by(x, at)).alias("trend"),
        F.count(x).alias("n"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def summary(snapshots: DataFrame) -> DataFrame:
    """Newest score, its verdict, articles and the change over the period."""
    x, at = F.col("sentiment_score"), F.struct("timestamp", "seq")
    rows = snapshots.groupBy("market").agg(F.max_by(x, at).alias("current"), F.sum("article_count").alias("articles"), F.count(x).alias("n"), (F.max_by(x, at) - F.min_by(x, at)).alias("change"))
    return rows.withColumn("verdict", F.when(F.col("current") > 0.15, "bullish").when(F.col("current") < -0.15, "bearish").otherwise("neutral"))


def display(snapshots: DataFrame, last: int = 5) -> DataFrame:
    order = Window.partitionBy("market").orderBy(F.desc("timestamp"), F.desc("seq"))
    x = F.col("sentiment_score")
    marker = F.when(x > 0.05, "+").when(x < -0.05, "-").otherwise("=")
    return snapshots.withColumns({"n": F.row_number().over(order).cast("long"), "marker": marker}).where(F.col("n") <= last).select("market", "n", "timestamp", "sentiment_score", "marker")


def freshness(snapshots: DataFrame, as_of: str, hours: int = 6) -> DataFrame:
    rows = snapshots.groupBy("market").agg(F.max("timestamp").alias("last_ts"))
    return rows.withColumn("fresh", F.col("last_ts") > _now(as_of) - F.expr(f"INTERVAL {hours} HOURS"))


def trading_hour(ts: Column) -> Column:
    return F.hour(local_time(ts)).between(9, 15) & (F.weekday(ts) < 5)


def slot_of(ts: Column) -> Column:
    minute = F.hour(local_time(ts)) * 60 + F.minute(local_time(ts))
    out = F.lit("idle")
    for name, (low, high) in SLOTS.items():
        out = F.when(minute.between(low, high), name).otherwise(out)
    return out


def signal_stats(snapshots: DataFrame) -> DataFrame:
    """current, recent_avg (last three), trend_latest, trend_all, volatility, n by market.

    Under three points there is nothing but n: rules then take the values as missing.
    Only the last three scores are kept as rows; the rest are aggregates.
    """
    x, at = F.col("sentiment_score"), F.struct("timestamp", "seq")
    order = Window.partitionBy("market").orderBy(F.desc("timestamp"), F.desc("seq"))
    last = snapshots.withColumn("_n", F.row_number().over(order)).where("_n <= 3").groupBy("market").agg(F.avg(x).alias("recent_avg"), F.max(F.when(F.col("_n") == 2, x)).alias("_prior"))
    sums = snapshots.groupBy("market").agg(F.max_by(x, at).alias("current"), F.min_by(x, at).alias("_first"), F.stddev_pop(x).alias("volatility"), F.count(x).alias("n"))
    found = {"current": F.col("current"), "recent_avg": F.col("recent_avg"), "trend_latest": F.col("current") - F.col("_prior"), "trend_all": F.col("current") - F.col("_first"), "volatility": F.col("volatility")}
    return sums.join(last, "market").select("market", *(F.when(F.col("n") >= 3, x).alias(name) for name, x in found.items()), "n")


def classify(stats: DataFrame) -> DataFrame:
    """Adds signal and confidence; under three points there is no signal."""
    cur, trend, change = F.col("current"), F.col("trend_latest"), F.col("trend_all")
    strong, slow = 0.5 + F.abs(cur) + F.abs(change) / 0.3, 0.5 + F.abs(change) / 0.4
    cases = [
        (F.col("n") < 3, "insufficient_data", F.lit(0.0)),
        ((cur > 0.15) & (trend >= 0), "bullish", strong),
        ((cur < -0.15) & (trend <= 0), "bearish", strong),
        ((change > 0.1) & (cur > -0.05), "improving", slow),
        ((change < -0.1) & (cur < 0.05), "deteriorating", slow),
    ]
    signal, confidence = F.lit("neutral"), F.lit(0.3)
    for test, name, value in reversed(cases):
        signal, confidence = F.when(test, name).otherwise(signal), F.when(test, value).otherwise(confidence)
    return stats.withColumns({"signal": signal, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))})


def market_signals(snapshots: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return classify(signal_stats(hour_dedup(recent(snapshots, as_of, hours))))


def _of(signals: DataFrame, market: str, prefix: str) -> DataFrame:
    """One market's values as one row, nulls where there is no data."""
    is_it = F.col("market") == market
    return signals.agg(*(F.max(F.when(is_it, F.col(c))).alias(f"{prefix}_{c}") for c in ("current", "recent_avg", "trend_all", "volatility", "signal")))


def _or0(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def slot_0700(snapshots: DataFrame, as_of: str) -> DataFrame:
    both = market_signals(snapshots, as_of, 12)
    row = _of(both, "CN", "cn").crossJoin(_of(both, "US", "us"))  # one row each
    row = row.withColumn("combined", _or0("cn_current") * 0.6 + _or0("us_current") * 0.4)
    x = F.col("combined")
    verdict = F.when(x > 0.1, "positive").when(x < -0.1, "negative").otherwise("neutral")
    risk = F.when(F.abs(x) < 0.1, "low").when(F.abs(x) < 0.3, "medium").otherwise("high")
    return row.select("combined", verdict.alias("assessment"), risk.alias("risk_level"), "cn_signal", "us_signal")


def slot_0925(snapshots: DataFrame, as_of: str) -> DataFrame:
    row = _of(market_signals(snapshots, as_of, 24), "CN", "d").crossJoin(_of(market_signals(snapshots, as_of, 4), "CN", "h"))  # one row each
    row = row.withColumn("blended", _or0("d_recent_avg") * 0.4 + _or0("h_recent_avg") * 0.3 + _or0("d_trend_all") * 0.3)
    x = F.col("blended")
    return row.select("blended", F.when(x > 0.15, "positive").when(x < -0.15, "negative").otherwise("neutral").alias("verdict"), F.when(x > -0.2, "proceed").otherwise("caution").alias("action"))


def slot_0955(snapshots: DataFrame, as_of: str) -> DataFrame:
    """Sell if sentiment is not bad, the other market is stable and volatility is low; data_ok tells of missing data."""
    both = market_signals(snapshots, as_of, 12)
    row = _of(both, "CN", "cn").crossJoin(_of(both, "US", "us"))  # one row each
    row = row.select(
        (_or0("cn_current") > -0.2).alias("sentiment_ok"),
        (~F.coalesce("us_signal", F.lit("neutral")).isin("bearish", "deteriorating")).alias("us_stable"),
        (_or0("cn_volatility") < 0.3).alias("volatility_ok"),
        (F.col("cn_current").isNotNull() & F.col("us_signal").isNotNull()).alias("data_ok"),
    )
    return row.withColumn("decision", F.when(F.col("sentiment_ok") & F.col("us_stable") & F.col("volatility_ok"), "SELL").otherwise("HOLD_CAUTION"))


def slot_1330(picks: DataFrame, snapshots: DataFrame, as_of: str, most: int = 10, published: int = 5) -> DataFrame:
    """The ranked picks with the buy rule of the day."""
    row = _of(market_signals(snapshots, as_of, 24), "CN", "cn").select(_or0("cn_current").alias("_cur"), F.coalesce("cn_signal", F.lit("no_data")).alias("sentiment_signal"))
    out = picks.where(F.col("rank") <= most).crossJoin(F.broadcast(row))  # one row
    return out.withColumns({"action": F.when(F.col("_cur") > -0.2, "buy").otherwise("buy_reduced"), "published": F.col("rank") <= published}).drop("_cur")


def yesterday_buys(journal: DataFrame, today: str) -> DataFrame:
    """The first buy entry of yesterday, else of the day before."""
    near = journal.where("slot = '1330'").where(F.col("entry_date").between(F.date_sub(F.lit(today).cast("date"), 2), F.date_sub(F.lit(today).cast("date"), 1)))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("entry_date"), "timestamp", "seq")  # two days' entries
    return near.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def slot_status(journal: DataFrame, today: str, hour: int) -> DataFrame:
    """done, missed or waiting for each slot of the day."""
    slots = journal.sparkSession.createDataFrame(list(SLOT_HOURS), "slot string, due int")
    done = journal.where(F.col("entry_date") == F.lit(today).cast("date")).select("slot").distinct().withColumn("_done", F.lit(True))
    state = F.when(F.col("_done"), "done").when(F.lit(hour) > F.col("due"), "missed").otherwise("waiting")
    return slots.join(done, "slot", "left").select("slot", state.alias("status"))


def is_trading_day(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """date, trading: a weekday that the calendar has."""
    known = calendar.select("date").distinct().withColumn("_known", F.lit(True))
    return dates.join(known, "date", "left").select("date", ((F.weekday("date") < 5) & F.coalesce("_known", F.lit(False))).alias("trading"))
