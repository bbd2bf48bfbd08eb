"""All that a market's run reads, from one place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources import views


@dataclass
class MarketData:
    """Bars and daily sentiment of a market's symbols, and the macro series."""

    ohlcv: DataFrame
    sentiment: DataFrame
    macro: DataFrame

    def summary(self) -> DataFrame:
        """part, n, first, last of each table."""
        parts = [
            rows.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")).withColumn("part", F.lit(name))
            for name, rows in (("ohlcv", self.ohlcv), ("sentiment", self.sentiment), ("macro", self.macro))
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("part", "n", "first", "last")


def fetch_market_data(spark: SparkSession, sf_dir: str, market: str, symbols: DataFrame, since: str | None = None) -> MarketData:
    """The market's bars (from ``since``), sentiment and macro, all lazy.  ``symbols`` (column symbol) may be of any size."""
    wanted = symbols.select("symbol").distinct()
    bars = views.bars(spark, sf_dir).where(F.col("market") == market)
    bars = bars if since is None else bars.where(F.col("date") >= F.lit(since).cast("date"))
    daily = views.daily_sentiment(spark, sf_dir)
    return MarketData(bars.join(wanted, "symbol", "left_semi"), daily.join(wanted, "symbol", "left_semi"), views.macro(spark, sf_dir))
