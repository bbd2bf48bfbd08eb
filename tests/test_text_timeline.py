"""Text scoring on literals, signals at their boundaries, and streams against their batch forms."""

import datetime

import pytest
from pyspark.sql import functions as F

from quantloom.operators import text, timeline
from quantloom.sources import tables, views
from quantloom.streaming import timeline as stream


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    ("said", "market", "score"),
    [
        ("Earnings BEAT the forecast", "US", 0.16),
        ("earnings miss and a crash", "US", -0.24),
        ("利空出尽", "CN", -0.16),
        ("涨停 st", "CN", 0.08),
        ("涨停 ST", "CN", 0.0),
        ("", "US", 0.0),
        (" ".join(text.EN_POSITIVE), "US", 0.5),
    ],
)
def test_lexicon(spark, said, market, score):
    assert one(spark, text.lexicon_boost_of(F.col("t"), F.col("m"), F.lit(0.0)), t=said, m=market) == pytest.approx(score)


def test_quick_sentiment(spark):
    assert one(spark, text.quick_sentiment_of(F.col("t"), F.col("m")), t="Rally and SURGE, no crash", m="US") == pytest.approx(0.15)
    assert one(spark, text.quick_sentiment_of(F.col("t"), F.col("m")), t="利好 大涨", m="CN") == pytest.approx(0.3)


@pytest.mark.parametrize(
    ("said", "market", "found"),
    [
        ("Buy $AAPL and $TSLA, then $AAPL", "US", ["AAPL", "TSLA"]),
        ("V is up, XYZ is not", "US", ["V"]),
        ("看好600519吗 000858 300750", "CN", ["000858.SZ", "300750.SZ"]),
        ("贵州茅台 688981 贵州茅台", "CN", ["688981.SS", "600519.SS"]),
        ("nothing", "US", []),
    ],
)
def test_tickers(spark, said, market, found):
    assert one(spark, text.tickers(F.col("t"), F.col("m")), t=said, m=market) == found


@pytest.mark.parametrize(
    ("written", "date"),
    [
        ("2024-01-05", "2024-01-05"),
        ("20240105", "2024-01-05"),
        ("2024-01-05T08:30:00Z", "2024-01-05"),
        ("2024-01-05 08:30:00", "2024-01-05"),
        ("20240105T083000", "2024-01-05"),
        ("05 Jan 2024 08:30:00 GMT", "2024-01-31"),
        ("garbage", "2024-01-31"),
        ("", "2024-01-31"),
        ("2024-01-05 something else", "2024-01-05"),
    ],
)
def test_dates(spark, written, date):
    assert one(spark, text.resolved_date(F.col("p"), F.lit("2024-01-31T00:00:00+00:00")), p=written) == date


def test_weights_and_labels(spark):
    schema = "type string, followers long, retweets long, likes long, comments long, score long, text string, comments_text string"
    rows = [("api", 10000, 0, 0, 0, 1000, "a", None), ("social", 10001, 0, 1001, 0, 0, "buy", None), ("rss", 200000, 5000, 0, 0, 0, " ", None)]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.select(text.article_weight()).collect()] == pytest.approx([1.2, 0.6 * 1.2 * 1.1001, 1.5 * 1.5])
    labels = [r.sentiment_label for r in text.analyzed(df, base=F.lit(0.35)).collect()]
    assert labels == ["positive", "neutral", None]  # 0.43 * 0.81 is under the bound


def snaps(spark, scores, market="CN", start=datetime.datetime(2024, 1, 30, 12), step=60):
    rows = [(i, start + datetime.timedelta(minutes=step * i), market, float(s), 1) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "seq long, timestamp timestamp, market string, sentiment_score double, article_count long")


@pytest.mark.parametrize(
    ("scores", "signal"),
    [
        ([0.1, 0.2], "insufficient_data"),
        ([0.1, 0.2, 0.3], "bullish"),
        ([0.3, 0.1, 0.15], "deteriorating" if 0.15 < 0.05 else "neutral"),
        ([0.0, -0.1, -0.2], "bearish"),
        ([-0.2, -0.1, 0.0], "improving"),
        ([0.2, 0.1, 0.0], "deteriorating"),
        ([0.0, 0.05, 0.05], "neutral"),
        ([0.0, 0.2, 0.16], "improving"),
        ([0.0, -0.3, -0.16], "deteriorating"),
    ],
)
def test_signals(spark, scores, signal):
    found = timeline.classify(timeline.signal_stats(snaps(spark, scores))).first()
    assert found.signal == signal
    assert 0 <= found.confidence <= 1


@pytest.mark.parametrize(("minute", "slot"), [(420, "0700"), (435, "0700"), (436, "idle"), (565, "0925"), (595, "0955"), (605, "0955"), (810, "1330"), (825, "1330"), (0, "idle")])
def test_slots_are_inclusive(spark, minute, slot):
    at = datetime.datetime(2024, 1, 10) + datetime.timedelta(minutes=minute - 480)
    assert spark.createDataFrame([(at,)], "t timestamp").select(timeline.slot_of(F.col("t"))).first()[0] == slot


def test_sell_passes_without_data_but_says_so(spark):
    row = timeline.slot_0955(snaps(spark, []), views.AS_OF).first()
    assert row.decision == "SELL" and not row.data_ok


def test_rules_take_values_of_under_three_points_as_missing(spark):
    late = datetime.datetime(2024, 1, 30, 21)
    row = timeline.slot_0955(snaps(spark, [-0.9, -0.9], start=late), views.AS_OF).first()
    assert row.decision == "SELL" and not row.data_ok
    assert timeline.slot_0955(snaps(spark, [-0.9, -0.9, -0.9], start=late), views.AS_OF).first().decision == "HOLD_CAUTION"
    assert timeline.slot_0700(snaps(spark, [-0.9, -0.9], start=late), views.AS_OF).first().combined == 0.0
    assert timeline.slot_0925(snaps(spark, [-0.9, -0.9], start=late), views.AS_OF).first().action == "proceed"
    picks = spark.createDataFrame([("000001", 1)], "symbol string, rank int")
    assert [timeline.slot_1330(picks, snaps(spark, [-0.9] * n, start=late), views.AS_OF).first().action for n in (2, 3)] == ["buy", "buy_reduced"]


def test_a_stream_that_starts_over_goes_on_from_the_table(spark, tmp_path):
    path, merge = str(tmp_path / "t"), stream.merge_into(str(tmp_path / "t"))
    seen = lambda: sorted(r.seq for r in stream.current(spark, path).collect())
    rows = snaps(spark, [0, 1, 2, 3, 4, 5])
    merge(rows.where("seq = 0"), 0)
    merge(rows.where("seq = 1"), 1)
    merge(rows.where("seq = 2"), 0)  # a new checkpoint counts from 0
    assert seen() == [0, 1, 2]
    merge(rows.where("seq = 2"), 0)  # the batch comes again
    assert seen() == [0, 1, 2]
    for n in (3, 4, 5):
        merge(rows.where(f"seq = {n}"), n)
    assert seen() == [0, 1, 2, 3, 4, 5] and len(tables.versions(spark, path)) == 3


def test_late_rows_inside_the_watermark_count_and_later_ones_are_dropped(spark, tmp_path):
    source, columns = str(tmp_path / "in"), "seq long, timestamp timestamp, market string, sentiment_score double, article_count long"
    at = lambda h, m=0: datetime.datetime(2024, 1, 10) + datetime.timedelta(hours=h, minutes=m)
    batches = [[(0, at(0), "CN", 0.1, 1), (1, at(100), "CN", 0.2, 1)], [(2, at(40, 30), "CN", 0.3, 1)], [(3, at(0, 30), "CN", 0.4, 1)], [(4, at(300), "CN", 0.5, 1)], [(5, at(301), "CN", 0.5, 1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(f"{source}/{i}")
    files = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    stream.run_available(stream.keep_last(files), str(tmp_path / "out"), str(tmp_path / "c"))
    # By 100 hours the first hour's window has been given out, so row 3 comes too late; row 2 does not.
    assert {r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {0, 1, 2} and spark.read.parquet(str(tmp_path / "out")).where("seq = 3").isEmpty()


def test_gaps_and_smoothing(spark):
    found = timeline.gaps(snaps(spark, [0, 0, 0], step=91)).collect()
    assert len(found) == 2 and found[0].gap_hours == pytest.approx(91 / 60)
    assert [r.smooth for r in timeline.curve(snaps(spark, [0.3, 0.6, 0.9])).orderBy("seq").collect()] == pytest.approx([0.3, 0.6, 0.5])


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    batch = views.snapshots(spark, sf_dir).select("seq", "timestamp", "market", "sentiment_score", "article_count")
    source = str(tmp_path / "in")
    batch.repartition(3).write.parquet(source)
    rows = stream.read(spark, source, batch.schema, 3)
    hourly = timeline.hour_dedup(batch)

    stream.run_available(stream.keep_last(rows), str(tmp_path / "hours"), str(tmp_path / "c1"))
    got = spark.read.parquet(str(tmp_path / "hours"))
    newest = batch.agg(F.max("timestamp")).first()[0] - datetime.timedelta(hours=74)
    key = lambda df: sorted((r.market, r.seq) for r in df.where(F.col("timestamp") < F.lit(newest)).collect())
    assert key(got) == key(hourly)

    merge = stream.merge_into(str(tmp_path / "table"))
    stream.read(spark, source, batch.schema, 1).writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    kept = stream.current(spark, str(tmp_path / "table"))
    last = batch.agg(F.max("timestamp")).first()[0] - datetime.timedelta(hours=72)
    want = hourly.where(F.col("timestamp") >= F.lit(last))
    assert sorted((r.market, r.seq) for r in kept.collect()) == sorted((r.market, r.seq) for r in want.collect())


def test_stream_gap_alarms_and_unique_urls(spark, tmp_path):
    df = snaps(spark, [0, 0, 0, 0], step=100).withColumn("url", F.element_at(F.array(F.lit("a"), F.lit("a"), F.lit(""), F.lit("")), (F.col("seq") + 1).cast("int")))
    source = str(tmp_path / "in")
    df.write.parquet(source)
    stream.run_available(stream.gap_alarms(stream.read(spark, source, df.schema, 10)), str(tmp_path / "g"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 3
    stream.run_available(stream.unique_urls(stream.read(spark, source, df.schema, 10)), str(tmp_path / "u"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 3
