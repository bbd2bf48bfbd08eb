"""Tables that jobs read and replace, and the files that they leave for others.

A table that a job reads and writes again is kept in versions: the new one is written
beside the old one and named in a marker table, so that a reader never sees a half-written
table and a job that is run again changes nothing.  There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.operators.selection import backtest, cumulative, topk_daily
from quantloom.operators.timeline import curve_snapshot, recent

# ------------------------------------------------------------------ versions


def latest_version(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.schema("version long").parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    except Exception as error:  # there is no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table, None before the first."""
    version = latest_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/v{version}")


def publish(df: DataFrame, path: str, version: int | None = None, partition_by: Sequence[str] = ()) -> int:
    """Writes df as the table's next (or the named) version and then names it current."""
    spark = df.sparkSession
    if version is None:
        before = latest_version(spark, path)
        version = 0 if before is None else before + 1
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/v{version}")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def versions(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(version, bytes) of the versions that are kept, the oldest first."""
    files, root = _files(spark, path)
    if not files.exists(root):
        return []
    found = [s.getPath() for s in files.listStatus(root) if s.isDirectory()]
    kept = [(int(p.getName()[1:]), p) for p in found if p.getName()[1:].isdigit() and p.getName().startswith("v")]
    return sorted((v, files.getContentSummary(p).getLength()) for v, p in kept)


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes all but the newest versions; those deleted."""
    files, _ = _files(spark, path)
    newest = latest_version(spark, path)
    old = [v for v, _ in versions(spark, path) if newest is not None and v <= newest][: -keep or None]
    for v in old:
        files.delete(_path(spark, f"{path}/v{v}"), True)
    return old


def clear(spark: SparkSession, path: str) -> None:
    """Deletes a table with all its versions."""
    files, root = _files(spark, path)
    files.delete(root, True)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    root = _path(spark, path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


# ------------------------------------------------------------------ bars


def refresh_bars(wanted: DataFrame, path: str, fetch: Callable[[DataFrame], DataFrame], as_of: str, days: int = 5) -> DataFrame:
    """The bars of the wanted symbols, after those that are not fresh have been fetched.

    ``fetch`` takes the symbols (column symbol) to fetch and returns their bars, which replace the
    symbol's old ones; bars of a symbol for which it returns nothing stay.  The table is written
    by market and only if there is something new.
    """
    spark = wanted.sparkSession
    held = current(spark, path)
    symbols = wanted.select("symbol").distinct()
    if held is None:
        new, rest = fetch(symbols), None
    else:
        fresh = held.groupBy("symbol").agg(F.max("date").alias("last")).where(F.col("last") >= F.date_sub(F.lit(as_of).cast("date"), days))
        stale = symbols.join(fresh, "symbol", "left_anti")
        if stale.isEmpty():
            return held.join(symbols, "symbol", "left_semi")
        new, rest = fetch(stale), held
    # Written first: a fetch is not repeated for the two places that read it.
    publish(new, f"{path}/fetched")
    new = current(spark, f"{path}/fetched")
    both = new if rest is None else rest.join(new.select("symbol").distinct(), "symbol", "left_anti").unionByName(new, allowMissingColumns=True)
    publish(both, path, partition_by=["market"])
    return current(spark, path).join(symbols, "symbol", "left_semi")


# ------------------------------------------------------------------ files for others


def write_predictions(picks: DataFrame, path: str, places: int = 4, extra: Sequence[str] = ("close", "name", "pct_chg", "rsi_14", "bb_position", "volume_ratio_5", "sentiment_score")) -> None:
    """Ranked picks as CSV with a header, rounded; extra columns where they exist."""
    chosen = ["market", "rank", "symbol", "pred_ret", *(c for c in extra if c in picks.columns)]
    kinds = dict(picks.dtypes)
    rows = picks.select(*(F.round(c, places).alias(c) if kinds[c] == "double" else F.col(c) for c in chosen))
    rows.repartitionByRange("market", "rank").sortWithinPartitions("market", "rank").write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_backtest(predictions: DataFrame, path: str, ks: tuple[int, ...] = (5, 10, 20, 30)) -> None:
    """The summary of all k as CSV, and each k's cumulative curve in a folder of its own."""
    backtest(predictions, ks).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary")  # one row a k
    cumulative(topk_daily(predictions, ks)).write.mode("overwrite").partitionBy("top_k").option("header", True).csv(f"{path}/curves")


def write_curve_snapshot(timeline: DataFrame, path: str, as_of: str, hours: int = 24) -> None:
    """The last hours' statistics of each market as JSON, with times as ISO text."""
    stats = curve_snapshot(recent(timeline, as_of, hours))
    iso = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(c) if kind == "timestamp" else F.col(c) for c, kind in stats.dtypes]
    stats.select(F.lit(as_of).alias("updated_at"), *iso).coalesce(1).write.mode("overwrite").json(path)  # one row a market


def write_articles(articles: DataFrame, daily: DataFrame, path: str, collected_at: str) -> None:
    """Analyzed articles and their aggregates as JSON by market, with the time they were collected."""
    for name, rows in (("articles", articles), ("aggregated", daily)):
        rows.withColumn("cached_at", F.lit(collected_at)).write.mode("overwrite").option("ignoreNullFields", False).partitionBy("market").json(f"{path}/{name}")


def read_articles(spark: SparkSession, path: str, schema: str, as_of: str, hours: int = 6) -> DataFrame:
    """Cached articles that are still fresh.  A line that does not parse is left out, as is what is too old."""
    rows = spark.read.option("mode", "DROPMALFORMED").schema(f"{schema}, cached_at string, market string").json(f"{path}/articles")
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp("cached_at"))
    return rows.where(age < hours * 3600).drop("cached_at")


def append_journal(entries: DataFrame, path: str) -> None:
    """Entries (entry_date and more) behind those of their day; no earlier entry is read or rewritten."""
    entries.write.mode("append").partitionBy("entry_date").parquet(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_decision(decision: DataFrame, path: str, as_of: str) -> None:
    """The sell decision as one JSON line: when, the checks and the verdict."""
    checks = F.struct("sentiment_ok", "us_stable", "volatility_ok", "data_ok").alias("checks")
    decision.select(F.lit(as_of).alias("timestamp"), checks, "decision").coalesce(1).write.mode("overwrite").json(path)  # one row


def write_ic(report: DataFrame, path: str) -> None:
    """Factors with their rank correlation as CSV, the strongest first."""
    report.orderBy(F.desc(F.abs("ic")), "name").write.mode("overwrite").option("header", True).csv(path)
