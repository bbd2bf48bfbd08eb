"""Queries that write and read again, collectors in several shapes, and streams run to their end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.session import shared_folder
from quantloom.operators import factors, models, preprocess, selection, text, timeline, validation
from quantloom.plans import queries as base
from quantloom.sources import commits, feeds, market, tables, views
from quantloom.streaming import timeline as streams

Query = Callable[[SparkSession, str], DataFrame]

_found: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


# ------------------------------------------------------------------ sinks, written and read again


@_query
def bar_buckets(spark, sf_dir):
    """As bar_cache, in buckets: those of symbols that are fresh keep their files."""
    every = views.bars(spark, sf_dir).select("market", "symbol", "date", "close")
    table = commits.BucketTable(spark, shared_folder(spark, "buckets"), "symbol", 32)
    old = F.pmod(F.xxhash64("symbol"), F.lit(32)) < 8
    table.change(every.where(~old | (F.col("date") < "1994-01-01")), lambda _, new: new)
    before = table.manifest().folders
    fetch = lambda stale: every.join(stale, "symbol", "left_semi")
    rows = commits.refresh_bars(every.select("symbol"), table, fetch, "1998-12-31", 400)
    kept = [b for b, folder in table.manifest().folders.items() if before.get(b) == folder]
    is_kept = F.pmod(F.xxhash64("symbol"), F.lit(32)).isin(kept) if kept else F.lit(False)
    return base.rounded(rows.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"), F.sum("close").alias("close"), F.bool_or(is_kept).alias("files_kept")))


@_query
def bar_cache(spark, sf_dir):
    """A stale half of the symbols is fetched anew, the others stay as they are."""
    path = shared_folder(spark, "bars")
    every = views.bars(spark, sf_dir).select("market", "symbol", "date", "close")
    odd = F.col("symbol").cast("long") % 2 == 1
    tables.publish(every.where(odd | (F.col("date") < "1994-01-01")), path, partition_by=["market"])
    fetch = lambda stale: every.join(stale, "symbol", "left_semi")
    rows = tables.refresh_bars(every.select("symbol"), path, fetch, "1998-12-31", 400)
    return base.rounded(rows.select("market", "symbol", "date", "close"))


@_query
def sink_predictions(spark, sf_dir):
    path = shared_folder(spark, "predictions")
    tables.write_predictions(selection.diversified(selection.latest(base.predictions(spark, sf_dir))), path)
    return tables.read_predictions(spark, path, "market string, rank long, symbol string, pred_ret double")


@_query
def sink_backtest(spark, sf_dir):
    path = shared_folder(spark, "backtest")
    tables.write_backtest(base.predictions(spark, sf_dir), path)
    return base.rounded(spark.read.option("header", True).schema("top_k int, sharpe double, final_cum double, n_days long, avg_daily_ret double").csv(f"{path}/summary"))


@_query
def sink_curves(spark, sf_dir):
    """The cumulative curve of each k, read from its folder."""
    path = shared_folder(spark, "backtest")
    tables.write_backtest(base.predictions(spark, sf_dir), path)
    curves = spark.read.option("header", True).schema("date string, ret double, n long, cum double, top_k int").csv(f"{path}/curves")
    return base.rounded(curves.select("top_k", F.substring("date", 1, 10).alias("date"), "ret", "cum"))


@_query
def table_contents(spark, sf_dir):
    """What the versions hold that are kept, of one version a market."""
    path = shared_folder(spark, "contents")
    for name in ("CN", "US", "KR", "JP"):
        tables.publish(views.snapshots(spark, sf_dir).where(F.col("market") == name).select("seq", "market"), path)
    tables.prune(spark, path, keep=3)
    kept = [spark.read.schema("seq long, market string").parquet(f"{path}/v{v}").withColumn("version", F.lit(v).cast("long")) for v, _ in tables.versions(spark, path)]
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("version", "market").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


@_query
def sink_curve_snapshot(spark, sf_dir):
    path = shared_folder(spark, "curve")
    tables.write_curve_snapshot(timeline.hour_dedup(views.snapshots(spark, sf_dir)), path, views.AS_OF)
    return base.rounded(spark.read.schema("market string, last double, low double, high double, n long, first_ts string").json(path))


@_query
def sink_articles(spark, sf_dir):
    path = shared_folder(spark, "articles")
    rows = views.articles(spark, sf_dir).where("market IS NOT NULL").select("seq", "market", "url")
    tables.write_articles(rows, rows.groupBy("market").count(), path, "2024-01-31T00:00:00Z")
    return tables.read_articles(spark, path, "seq long, url string", "2024-01-31 05:00:00").select("seq", "market", "url")


@_query
def sink_journal(spark, sf_dir):
    path = shared_folder(spark, "journal")
    entries = views.journal(spark, sf_dir)
    for part in ("slot = '0700'", "slot != '0700'"):
        tables.append_journal(entries.where(part), path)
    return tables.read_journal(spark, path).groupBy(F.col("entry_date").cast("date").alias("entry_date"), "slot").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


@_query
def sink_decision(spark, sf_dir):
    path = shared_folder(spark, "decision")
    tables.write_decision(timeline.slot_0955(views.snapshots(spark, sf_dir), views.AS_OF), path, views.AS_OF)
    checks = "struct<sentiment_ok: boolean, us_stable: boolean, volatility_ok: boolean, data_ok: boolean>"
    return spark.read.schema(f"timestamp string, checks {checks}, decision string").json(path).select("timestamp", "checks.*", "decision")


@_query
def sink_ic(spark, sf_dir):
    path = shared_folder(spark, "ic")
    tables.write_ic(validation.rank_ic(base._labelled(spark, sf_dir), base.FEATURES), path)
    return base.rounded(spark.read.option("header", True).schema("name string, ic double, n long").csv(path))


@_query
def timeline_versions(spark, sf_dir):
    """Each market's snapshots merged as a batch of their own, then the newest version read."""
    path = shared_folder(spark, "timeline")
    merge = streams.merge_into(path)
    rows = views.snapshots(spark, sf_dir).select("seq", "timestamp", "market", "sentiment_score", "article_count")
    for i, name in enumerate(("CN", "US", "KR", "JP", "CN")):  # the first batch comes again
        merge(rows.where(F.col("market") == name), i)
    return base.rounded(tables.current(spark, path))


@_query
def table_admin(spark, sf_dir):
    """Versions that are kept after some were deleted, and whether they hold data."""
    path = shared_folder(spark, "admin")
    for n in (1, 2, 3):
        tables.publish(views.universe(spark, sf_dir).limit(n), path)
    tables.prune(spark, path, keep=2)
    kept = [(v, size > 0, v == tables.latest_version(spark, path)) for v, size in tables.versions(spark, path)]
    return spark.createDataFrame(kept, "version long, filled boolean, current boolean")


# ------------------------------------------------------------------ collectors


@_query
def feed_entity(spark, sf_dir):
    rows = feeds.entity_articles(views.responses(spark, sf_dir, "entity"))
    return base.rounded(rows.select("url", "market", "title", "summary", "text", "published", "sentiment", F.get("entities", F.lit(0))["symbol"].alias("entity")))


@_query
def feed_entity_daily(spark, sf_dir):
    return base.rounded(feeds.entity_daily(views.responses(spark, sf_dir, "entity")))


@_query
def feed_table(spark, sf_dir):
    rows = feeds.table_articles(views.news_pages(spark, sf_dir), lambda t, _: text.quick_sentiment(t, base.POSITIVE, base.NEGATIVE))
    return base.rounded(rows.select("url", "market", "title", "published", "sentiment"))


@_query
def feed_social(spark, sf_dir):
    return feeds.network_articles(views.social_posts(spark, sf_dir)).select("source", "source_cn", "market", "language", "url", "title", F.length("text").alias("length"), "likes")


@_query
def social_mix(spark, sf_dir):
    return feeds.social_mix(feeds.network_articles(views.social_posts(spark, sf_dir).where("url != ''")), 40).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("likes").alias("likes"))


@_query
def social_communities(spark, sf_dir):
    """The first posts of each subreddit and channel, some of which are not read."""
    turn = F.floor(F.col("seq") / 4)
    read = [*(c for found in feeds.CHANNELS.values() for c in found), *feeds.OTHER_CHANNELS, "elsewhere"]
    place = F.when(F.col("network") == "reddit", views._pick([*feeds.SUBREDDITS, "elsewhere"], turn % 5)).when(F.col("network") == "telegram", views._pick(read, turn % len(read)))
    posts = views.social_posts(spark, sf_dir).where("url != ''").withColumn("community", place)
    found = feeds.community_articles(posts, 20, ["seq"])
    return found.groupBy("source", "source_cn", "market").agg(F.count(F.lit(1)).alias("n"), F.sum("likes").alias("likes"), F.max("url").alias("last_url"))


@_query
def rss_sources(spark, sf_dir):
    every = [feeds.sources_for(views.feed_sources(spark), m).select(F.lit(m).alias("market"), "source") for m in ("CN", "US", "KR", "JP")]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])


@_query
def feed_bars(spark, sf_dir):
    """Bars under a provider's headers, with moves in percent."""
    given = {"日期": F.date_format("date", "yyyy-MM-dd"), "开盘": F.col("open"), "收盘": F.col("close"), "成交量": F.col("volume"), "涨跌幅": 100 * (F.col("close") / F.col("open") - 1)}
    rows = views.bars(spark, sf_dir).select("symbol", *(x.alias(name) for name, x in given.items()))
    return base.rounded(feeds.named_bars(rows).select("symbol", "date", "open", "close", "volume", "pct_chg"))


@_query
def feed_long_bars(spark, sf_dir):
    """A table with a column for each symbol and field, as one row for each date and symbol."""
    symbols = ["000001", "000002", "000003"]
    wide = views.bars(spark, sf_dir).groupBy("date").pivot("symbol", symbols).agg(F.max("close").alias("Close"), F.max("volume").alias("Volume"))
    return base.rounded(feeds.long_bars(wide, symbols).select("date", "symbol", "open", "close", "volume"))


@_query
def sentiment_records(spark, sf_dir):
    """Daily scores as text records, some of them broken, made typed again."""
    rows = views.daily_sentiment(spark, sf_dir)
    odd = F.col("symbol").cast("long")
    texts = rows.select(
        F.when(odd % 11 == 0, "soon").otherwise(F.date_format("date", "yyyy-MM-dd'T'00:00:00")).alias("date"),
        "symbol",
        F.when(odd % 7 == 0, "n/a").otherwise(F.col("sentiment_score").cast("string")).alias("sentiment_score"),
        F.col("news_count").cast("string").alias("news_count"),
    )
    return base.rounded(feeds.daily_records(texts))


def _broken():
    raise TimeoutError("no answer")


@_query
def news_fan_out(spark, sf_dir):
    """Three providers and one that fails."""
    quick = lambda t, _: text.quick_sentiment(t, base.POSITIVE, base.NEGATIVE)
    providers = {
        "alpha_vantage": lambda: feeds.scored_articles(views.responses(spark, sf_dir, "scored")),
        "newsapi": _broken,
        "marketaux": lambda: feeds.entity_articles(views.responses(spark, sf_dir, "entity")),
        "finviz": lambda: feeds.table_articles(views.news_pages(spark, sf_dir), quick),
    }
    return base.rounded(feeds.fan_out(spark, providers, 200).select("url", F.abs("sentiment").alias("strength"), "error"))


@_query
def news_fan_out_at_run_time(spark, sf_dir):
    """A provider whose rows cannot be read, because one of them is no number, and two others."""
    broken = views.responses(spark, sf_dir, "scored").withColumn("body", F.raise_error(F.concat(F.lit("bad answer to "), F.col("body"))).cast("string"))
    providers = {
        "alpha_vantage": lambda: feeds.scored_articles(views.responses(spark, sf_dir, "scored")),
        "newsapi": lambda: feeds.scored_articles(broken),
        "marketaux": lambda: feeds.entity_articles(views.responses(spark, sf_dir, "entity")),
    }
    found = feeds.fan_out(spark, providers, 200)
    return base.rounded(found.select("url", F.abs("sentiment").alias("strength"), F.when(F.col("error").isNotNull(), F.col("source")).alias("failed")))


@_query
def snapshot_failures(spark, sf_dir):
    """Markets with their articles, and a row for the one whose fetch failed."""
    every = base._analyzed(spark, sf_dir)
    lost = every.where("market = 'KR'").groupBy("market").agg(F.concat(F.lit("TimeoutError: lost "), F.count(F.lit(1)).cast("string")).alias("error"))
    also = every.where("market = 'US'").select("market", F.lit("one provider failed").alias("error"))
    rows = text.snapshot(every.where("market != 'KR'"), views.AS_OF, lost.unionByName(also))
    return rows.select("market", "article_count", "error")


@_query
def universe_select(spark, sf_dir):
    known, none = views.universe(spark, sf_dir), views.universe(spark, sf_dir).where("false")
    tagged = [selection.universe(rows, m).withColumn("known", F.lit(k)) for rows, m, k in ((known, "CN", True), (none, "CN", False), (known, "US", True), (known, "KR", True), (known, "XX", True))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3]).unionByName(tagged[4])


@_query
def market_data(spark, sf_dir):
    symbols = selection.universe(views.universe(spark, sf_dir), "CN").select(F.col("code").alias("symbol"))
    return market.fetch_market_data(spark, sf_dir, "CN", symbols, "1995-01-01").summary()


@_query
def clean_columns(spark, sf_dir):
    rows = views.macro(spark, sf_dir).withColumnsRenamed({"urgent": "^VIX", "high": "DX-Y.NYB", "medium": "Medium"})
    return base.rounded(preprocess.clean_columns(rows))


# ------------------------------------------------------------------ rules and scores


@_query
def filter_audit(spark, sf_dir):
    return selection.filter_audit(base._ruled(spark, sf_dir), views.market_rules(spark))


@_query
def ticker_whitelist(spark, sf_dir):
    listed = spark.createDataFrame([("AAPL",), ("V",), ("NONE",)], "ticker string")
    rows = text.by_ticker(base._analyzed(spark, sf_dir), listed)
    return base.rounded(text.ticker_sentiment(rows).select("ticker", "sentiment_score", "news_count"))


@_query
def news_snapshot(spark, sf_dir):
    rows = text.snapshot(base._analyzed(spark, sf_dir), views.AS_OF)
    best = F.from_json("top_tickers", "array<struct<ticker: string, score: double, count: long>>")
    counts = F.from_json("source_counts", "map<string, long>")
    return base.rounded(
        rows.select("market", "timestamp", "sentiment_score", "article_count", F.size(counts).alias("sources"), F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x).alias("counted"), F.array_join(F.transform(best, lambda t: t["ticker"]), ",").alias("tickers"), "is_trading_hour", "error")
    )


@_query
def model_round_trip(spark, sf_dir):
    """A forest trained, saved and loaded again: its importances, which add up to 1, by feature."""
    path = shared_folder(spark, "model")
    rows = base._labelled(spark, sf_dir).where("label IS NOT NULL").select("market", "symbol", "date", "label", *base.FEATURES)
    models.save(models.ranker(base.FEATURES, "forest", numTrees=5, maxDepth=4).fit(models.with_target(rows)), path)
    return spark.createDataFrame(models.importance(models.load(path), base.FEATURES), "feature string, importance double")


@_query
def ic_p_values(spark, sf_dir):
    ics = validation.ic_report(validation.rank_ic(base._labelled(spark, sf_dir), base.FEATURES))
    return base.rounded(validation.with_p_values(ics))


# ------------------------------------------------------------------ streams, run to their end


def _stream(spark: SparkSession, sf_dir: str, to: str) -> tuple[DataFrame, str]:
    """The events as a stream of snapshots, and the folder that its query writes to."""
    schema = views.table(spark, sf_dir, "events").schema
    events = streams.read(spark, f"{sf_dir}/events.parquet*", schema, 1000)
    return views.as_snapshots(events), shared_folder(spark, to)


def _ended(rows: DataFrame, folder: str) -> DataFrame:
    streams.run_available(rows, f"{folder}/rows", f"{folder}/checkpoint")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


@_query
def stream_hours(spark, sf_dir):
    rows, folder = _stream(spark, sf_dir, "stream-hours")
    return base.rounded(_ended(streams.keep_last(rows), folder).select("hour", "market", "seq", "sentiment_score", "article_count"))


@_query
def stream_means(spark, sf_dir):
    rows, folder = _stream(spark, sf_dir, "stream-means")
    return base.rounded(_ended(streams.sliding_mean(rows, "24 hours", "6 hours"), folder))


@_query
def stream_sessions(spark, sf_dir):
    rows, folder = _stream(spark, sf_dir, "stream-sessions")
    return _ended(streams.sessions(rows), folder)


@_query
def stream_urls(spark, sf_dir):
    rows, folder = _stream(spark, sf_dir, "stream-urls")
    rows = rows.withColumn("url", F.when(F.col("seq") % 50 == 0, "").otherwise(F.concat(F.lit("https://ex.org/"), (F.col("seq") % 600).cast("string"))))
    return _ended(streams.unique_urls(rows.select("seq", "timestamp", "url"), "1000 hours"), folder).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@_query
def stream_gaps(spark, sf_dir):
    rows, folder = _stream(spark, sf_dir, "stream-gaps")
    return base.rounded(_ended(streams.gap_alarms(rows, 0.75), folder))


@_query
def stream_settled_gaps(spark, sf_dir):
    """Gaps between snapshots that have been put in order up to the watermark."""
    rows, folder = _stream(spark, sf_dir, "stream-settled")
    return base.rounded(_ended(streams.gap_alarms(rows, 0.75, "24 hours", settled=True), folder).where("gap_end IS NOT NULL"))


def queries() -> dict[str, Query]:
    return _found
