"""Structured Streaming forms of the timeline: keep-last windows, dedup, gaps, merge.

Late rows inside the watermark take part in their window; later ones are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantloom.operators.timeline import hour_dedup
from quantloom.sources.tables import current, prune, publish


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def keep_last(snapshots: DataFrame, late: str = "72 hours", width: str = "1 hour") -> DataFrame:
    """The last snapshot of each window and market (dropDuplicates would keep the first)."""
    rows = snapshots.withWatermark("timestamp", late)
    at = F.struct("timestamp", "seq")
    last = F.max_by(F.struct("timestamp", "seq", "sentiment_score", "article_count"), at).alias("row")
    return rows.groupBy(F.window("timestamp", width), "market").agg(last).select(F.col("window.start").alias("hour"), "market", "row.*")


def sliding_mean(snapshots: DataFrame, width: str = "24 hours", step: str = "1 hour", late: str = "72 hours") -> DataFrame:
    rows = snapshots.withWatermark("timestamp", late).groupBy(F.window("timestamp", width, step), "market")
    return rows.agg(F.avg("sentiment_score").alias("mean_score"), F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("until"), "market", "mean_score", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "72 hours") -> DataFrame:
    rows = events.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap), "market")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "market", "n")


def unique_urls(articles: DataFrame, late: str = "72 hours") -> DataFrame:
    """Each URL once within the watermark; articles without one all pass."""
    rows = articles.withWatermark("timestamp", late)
    return rows.withColumn("_key", F.when(F.col("url") == "", F.concat(F.lit("#"), F.col("seq").cast("string"))).otherwise(F.col("url"))).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def _bounds(frames: Iterator[pd.DataFrame], width: int, after: int | None, held: dict[int, list[int]]) -> dict[int, list[int]]:
    """First and last time of each bucket of ``width``, in which no longer gap can lie; frame by frame."""
    for frame in frames:
        times = frame["micros"] if after is None else frame["micros"][frame["micros"] > after]
        for bucket, low, high in times.groupby(times // width).agg(["min", "max"]).itertuples():
            known = held.setdefault(bucket, [low, high])
            held[bucket] = [min(known[0], low), max(known[1], high)]
    return held


def gap_alarms(snapshots: DataFrame, hours: float = 1.5, late: str = "72 hours", settled: bool = False) -> DataFrame:
    """market, gap_start, gap_end, gap_hours of gaps between a market's consecutive snapshots.

    A gap is told when the snapshot that ends it arrives; a snapshot before one that has been
    taken never makes one.  With ``settled`` a market's snapshots are put in order up to the
    watermark first, so a late one that fills a gap prevents the alarm.  A market from which
    nothing comes for so long gets an alarm with a null gap_end, by a timer of event time: the
    watermark that fires it moves on with the other markets.  What is kept of a market are two
    times for each stretch of ``hours`` within the watermark's delay.
    """
    width = int(hours * 3_600_000_000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told, lows, highs = state.get if state.exists else (None, False, [], [])
        mark = state.getCurrentWatermarkMs() * 1000
        pending = {low // width: [low, high] for low, high in zip(lows, highs, strict=True)}
        if not state.hasTimedOut:
            pending = _bounds(frames, width, last, pending)
        found = []
        for bucket in sorted(pending):
            low, high = pending[bucket]
            if settled and high > mark:
                if low > mark:
                    break
                high = max(low, last or low)  # what lies between comes when the watermark has passed it
            if last is not None and low - last > width:
                found.append((key[0], last, low, (low - last) / 3_600_000_000))
            last, told = max(high, last or high), False
            if not settled or pending[bucket][1] <= mark:
                del pending[bucket]
            else:
                pending[bucket][0] = pending[bucket][1]
                break
        if last is not None and not told and not pending and state.hasTimedOut and mark - last > width:
            found.append((key[0], last, None, None))
            told = True
        left = sorted(pending.values())
        state.update((last, told, [x[0] for x in left], [x[1] for x in left]))
        due = [left[0][0]] if left else [] if told or last is None else [last + width]
        if due:
            state.setTimeoutTimestamp(max(due[0] // 1000 + 1, mark // 1000 + 1))
        yield pd.DataFrame(found, columns=["market", "start", "end", "gap_hours"]).astype({"start": "Int64", "end": "Int64", "gap_hours": "float64"})

    rows = snapshots.withWatermark("timestamp", late).select("market", "timestamp", F.unix_micros("timestamp").alias("micros"))
    gaps = rows.groupBy("market").applyInPandasWithState(
        step, "market string, start long, end long, gap_hours double", "last long, told boolean, lows array<long>, highs array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
    hours_or_null = F.when(F.col("end").isNotNull(), F.col("gap_hours"))
    return gaps.select("market", F.timestamp_micros("start").alias("gap_start"), F.timestamp_micros("end").alias("gap_end"), hours_or_null.alias("gap_hours"))


def merge_into(path: str, retention_hours: int = 72, versions: int = 3):
    """A foreachBatch function that keeps the timeline table at ``path`` deduplicated and pruned.

    Every batch is merged with the newest version into a next one, which is then named in a
    marker table: a reader never sees a half-written table, and a stream that starts over with
    batch 0 goes on from what is there.  A batch that comes again changes nothing, because the
    last row of an hour stays the last one.  Only the newest ``versions`` are kept.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = current(spark, path)
        rows = batch if before is None else before.unionByName(batch)
        rows = hour_dedup(rows)
        newest = rows.agg(F.max("timestamp").alias("_newest"))
        rows = rows.crossJoin(F.broadcast(newest)).where(F.col("timestamp") >= F.col("_newest") - F.expr(f"INTERVAL {retention_hours} HOURS")).drop("_newest")  # one row
        publish(rows, path)
        prune(spark, path, versions)

    return merge


def run_available(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes all that is there and stops, as an hourly job does."""
    query = rows.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
