"""Gap alarms with late rows, restarts and silence; providers that fail while they are read."""

import pytest
from pyspark.sql import functions as F

from quantloom.operators import text
from quantloom.sources import feeds
from quantloom.streaming import timeline as stream

SCHEMA = "market string, timestamp timestamp"


class Feed:
    """A stream of batches, one file each, run after each of them on the same checkpoint."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.files = spark, str(folder), options, 0

    def send(self, *rows):
        path = f"{self.folder}/in"
        frame = self.spark.createDataFrame([(m, f"2024-01-{t}") for m, t in rows], "market string, t string").select("market", F.col("t").cast("timestamp").alias("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(path)
        gaps = stream.gap_alarms(stream.read(self.spark, path, frame.schema), **self.options)
        stream.run_available(gaps, f"{self.folder}/out", f"{self.folder}/checkpoint")
        found = self.spark.read.schema(gaps.schema).parquet(f"{self.folder}/out").collect()
        text_of = lambda t: t and t.strftime("%d %H:%M")
        return sorted(((r.market, text_of(r.gap_start), text_of(r.gap_end), r.gap_hours and round(r.gap_hours, 2)) for r in found), key=str)


def test_a_late_row_makes_no_alarm(spark, tmp_path):
    feed = Feed(spark, tmp_path, hours=1.5)
    assert feed.send(("A", "01 09:00"), ("A", "01 10:00")) == []
    assert feed.send(("A", "01 08:00"), ("A", "01 10:10")) == []
    # The state lives through restarts: every batch here is a new run.
    assert feed.send(("A", "01 12:00"), ("A", "01 12:00")) == [("A", "01 10:10", "01 12:00", 1.83)]


def test_a_late_row_that_fills_a_gap_prevents_the_alarm_when_settled(spark, tmp_path):
    feed = Feed(spark, tmp_path, hours=1.0, late="3 hours", settled=True)
    assert feed.send(("A", "01 09:00"), ("A", "01 11:00"), ("A", "01 11:10")) == []
    assert feed.send(("A", "01 10:00"), ("A", "01 11:30")) == []
    assert feed.send(("A", "01 20:00")) == []  # nothing is missing up to 11:30, and 20:00 is not settled yet
    assert feed.send(("A", "01 20:10"), ("B", "02 09:00")) == [("A", "01 11:30", "01 20:00", 8.5), ("A", "01 20:10", None, None)]


def test_silence_is_told_once_and_ends(spark, tmp_path):
    feed = Feed(spark, tmp_path, hours=2.0, late="0 seconds")
    feed.send(("A", "01 09:00"), ("B", "01 09:00"))
    assert feed.send(("B", "01 10:00")) == []
    silent = feed.send(("B", "01 11:30"))
    assert silent == [("A", "01 09:00", None, None)]
    assert feed.send(("B", "01 12:30")) == silent
    assert feed.send(("A", "01 13:00"), ("B", "01 13:00")) == [("A", "01 09:00", "01 13:00", 4.0), *silent]


def article(spark, url, sentiment):
    return spark.createDataFrame([(url, sentiment)], "url string, sentiment double").select(
        *(F.col(c).cast(kind).alias(c) if c in ("url", "sentiment") else F.lit(None).cast(kind).alias(c) for c, kind in feeds.ARTICLE.items())
    )


def test_a_provider_that_fails_while_it_is_read_leaves_one_row(spark):
    def lazy_udf():
        bad = F.udf(lambda x: {}[x], "double")
        return article(spark, "x", 1.0).withColumn("sentiment", bad("url"))

    providers = {
        "good": lambda: article(spark, "a", 0.5),
        "task": lazy_udf,
        "jvm": lambda: article(spark, "y", 1.0).withColumn("url", F.raise_error(F.lit("no such page")).cast("string")),
        "plan": lambda: spark.table("nowhere"),
        "more": lambda: article(spark, "b", -0.9),
    }
    found = feeds.fan_out(spark, providers, 5).collect()
    assert [(r.url, r.error) for r in found if r.url] == [("b", None), ("a", None)] or {(r.url, r.error) for r in found if r.url} == {("a", None), ("b", None)}
    errors = {r.source: r.error for r in found if r.error}
    assert set(errors) == {"task", "jvm", "plan"} and errors["task"].startswith("KeyError") and "no such page" in errors["jvm"] and "nowhere" in errors["plan"]
    assert {r.error is None for r in feeds.fan_out(spark, {"task": lazy_udf}, 5).collect()} == {False}


@pytest.mark.parametrize("with_failures", [True, False])
def test_one_error_row_for_each_failed_market(spark, sf_dir, with_failures):
    from quantloom.plans import queries
    from quantloom.sources import views

    rows = queries._analyzed(spark, sf_dir).where("market IN ('CN', 'US')")
    failures = spark.createDataFrame([("KR", "a"), ("KR", "b"), ("CN", "one of several")], "market string, error string") if with_failures else None
    found = {r.market: r for r in text.snapshot(rows, views.AS_OF, failures).collect()}
    assert set(found) == ({"CN", "US", "KR"} if with_failures else {"CN", "US"}) and found["CN"].error is None
    if with_failures:
        assert (found["KR"].error, found["KR"].sentiment_score, found["KR"].article_count, found["KR"].top_tickers, found["KR"].source_counts) == ("a; b", 0.0, 0, "[]", "{}")
