"""The catalogue of queries: every operator bound to the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.expr import clamp
from quantloom.functions.session import Tables, dealt
from quantloom.operators import boosting, causal, factors, models, preprocess, selection, text, timeline, validation
from quantloom.sources import feeds, views

Query = Callable[[SparkSession, str], DataFrame]
FEATURES = ["close_ma_5_ratio", "roc_5", "momentum_10d", "volume_ratio_5"]
#: Words that occur in the invented prose, for queries on the lexicon operators.
POSITIVE, NEGATIVE, WATCHED = ["the", "and", "here"], ["ion", "rest"], ["the", "Tion", "zzz"]
TODAY, STATUS_HOUR = "2024-01-20", 10
TRAIN, STEP = 104, 5
POINTWISE = boosting.Settings(objective="squared", judge="ndcg")

_found: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, with one zero."""
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars dealt by symbol, for windows over a symbol's rows: tasks grow in number with the input."""
    return dealt(views.bars(spark, sf_dir), "symbol")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _series(spark, sf_dir)
    out = factors.volume(factors.momentum(factors.roc(factors.ma(bars, (5,)), (5,)), (10,)))
    return out.withColumns({c: F.round(c, 12) for c in FEATURES})


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with the label that is neutral to the market."""
    out = preprocess.neutral_label(factors.label(_features(spark, sf_dir)))
    return out.withColumn("label", F.round("label", 12))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _labelled(spark, sf_dir).where("label IS NOT NULL").withColumn("pred_ret", F.col("close_ma_5_ratio"))
    return out.select("market", "date", "symbol", "industry", "pred_ret", "label")


# ------------------------------------------------------------------ sources and sinks


@_query
def src_bars(spark, sf_dir):
    return rounded(factors.pct_change(_series(spark, sf_dir)))


@_query
def universe_lpad(spark, sf_dir):
    return views.universe(spark, sf_dir)


@_query
def macro_pivot(spark, sf_dir):
    return views.macro(spark, sf_dir)


@_query
def cache_freshness_split(spark, sf_dir):
    last = views.bars(spark, sf_dir).groupBy("symbol").agg(F.max("date").alias("last_date"))
    newest = last.agg(F.max("last_date").alias("newest"))
    status = F.when(F.col("last_date") >= F.date_sub("newest", 5), "cached").otherwise("fetch")
    return last.crossJoin(F.broadcast(newest)).select("symbol", "last_date", status.alias("status"))  # one row


@_query
def trading_day(spark, sf_dir):
    calendar = views.table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).where("day(date) != 15")
    dates = spark.sql("SELECT explode(sequence(DATE'2023-12-25', DATE'2024-02-10')) AS date")
    return timeline.is_trading_day(dates, calendar)


@_query
def cache_fresh(spark, sf_dir):
    return timeline.freshness(views.snapshots(spark, sf_dir), "2024-01-31 05:00:00")


@_query
def union_by_name(spark, sf_dir):
    bars = views.bars(spark, sf_dir).select("market", "symbol", "date", "close")
    cn = bars.where("market = 'CN'").withColumn("extra", F.lit(1))
    return rounded(cn.unionByName(bars.where("market != 'CN'"), allowMissingColumns=True))


@_query
def distinct_symbols(spark, sf_dir):
    return views.bars(spark, sf_dir).groupBy("market").agg(F.countDistinct("symbol").alias("symbols"), F.countDistinct("date").alias("dates"))


@_query
def rss_normalize(spark, sf_dir):
    rows = views.articles(spark, sf_dir).where("type = 'rss' AND length(trim(text)) > 0")
    rows = rows.withColumn("summary", F.substring("text", 1, 500))
    return text.capped(rows, "source", 20, "seq").select("seq", "source", "market", "title", "summary", "url")


@_query
def source_quota(spark, sf_dir):
    rows = views.articles(spark, sf_dir).where("type = 'social'")
    return text.capped(rows, "source", 8, F.desc("likes"), "seq").select("seq", "source", "likes")


@_query
def comment_concat(spark, sf_dir):
    said = F.concat_ws(" ", F.transform("later", lambda t: F.coalesce(t["text"], F.lit(""))))
    return views.posts(spark, sf_dir).select("conv_id", F.coalesce("title", F.lit("")).alias("title"), F.substring(said, 1, 2000).alias("comments"))


@_query
def html_links(spark, sf_dir):
    return text.links(views.table(spark, sf_dir, "pages"))


@_query
def feed_scored(spark, sf_dir):
    rows = feeds.scored_articles(views.responses(spark, sf_dir, "scored"))
    told = lambda t: F.col("ticker_sentiments")[t]["score"]
    return rounded(rows.select("url", "market", "title", "summary", "text", "published", "sentiment", "sentiment_label", told("AAPL").alias("apple"), told("V").alias("visa"), F.size("ticker_sentiments").alias("n_tickers")))


@_query
def feed_news(spark, sf_dir):
    rows = feeds.news_articles(views.responses(spark, sf_dir, "news"), WATCHED, lambda t, _: text.quick_sentiment(t, POSITIVE, NEGATIVE))
    return rounded(rows.select("url", "market", "source_name", "title", "summary", "text", "published", "language", "sentiment", "relevance"))


@_query
def feed_daily(spark, sf_dir):
    return rounded(feeds.scored_daily(views.responses(spark, sf_dir, "scored")))


@_query
def strongest_articles(spark, sf_dir):
    return rounded(feeds.strongest(feeds.scored_articles(views.responses(spark, sf_dir, "scored")), 40).select("url", "sentiment"))


# ------------------------------------------------------------------ factors


def _factor(name: str) -> Query:
    return lambda spark, sf_dir: rounded(factors.family(views.bars(spark, sf_dir), name))


for _name in factors.FAMILIES:
    _found[f"f_{_name}"] = _factor(_name)


@_query
def label_t1(spark, sf_dir):
    return rounded(factors.label(_series(spark, sf_dir)).select("symbol", "date", "label"))


@_query
def label_neutral(spark, sf_dir):
    return rounded(preprocess.neutral_label(factors.label(_series(spark, sf_dir))).select("symbol", "date", "label"))


# ------------------------------------------------------------------ joins and preprocessing


@_query
def join_sentiment(spark, sf_dir):
    bars = views.bars(spark, sf_dir).select("symbol", "date", "close")
    return rounded(preprocess.add_sentiment(bars, views.daily_sentiment(spark, sf_dir)))


@_query
def s_rolling(spark, sf_dir):
    panel = preprocess.add_sentiment(_features(spark, sf_dir), views.daily_sentiment(spark, sf_dir))
    out = preprocess.sentiment_features(panel)
    return rounded(out.select("symbol", "date", *(c for c in out.columns if c.startswith("sentiment_") and c not in ("sentiment_score", "sentiment_std"))))


@_query
def join_macro(spark, sf_dir):
    bars = views.bars(spark, sf_dir).select("symbol", "date", "close")
    return rounded(preprocess.add_macro(bars, views.macro(spark, sf_dir)))


@_query
def macro_change(spark, sf_dir):
    return rounded(preprocess.macro_changes(views.macro(spark, sf_dir), views.MACRO))


@_query
def clean_nonfinite(spark, sf_dir):
    odd = F.when(F.day("date") % 5 == 0, float("nan")).when(F.day("date") % 7 == 0, float("inf")).when(F.day("date") % 11 == 0, None).otherwise(F.col("close"))
    return rounded(preprocess.clean_nonfinite(views.bars(spark, sf_dir).select("symbol", "date", odd.alias("x")), ["x"]))


@_query
def winsorize(spark, sf_dir):
    return rounded(preprocess.winsorize(_features(spark, sf_dir).select("symbol", "date", *FEATURES), FEATURES))


@_query
def winsorize_to_date(spark, sf_dir):
    """Bounds without the future."""
    return rounded(causal.winsorize_to_date(_features(spark, sf_dir).select("symbol", "date", *FEATURES), FEATURES))


@_query
def cs_rank(spark, sf_dir):
    return rounded(preprocess.cross_sectional_rank(_features(spark, sf_dir).select("market", "symbol", "date", *FEATURES), FEATURES))


@_query
def ts_zscore(spark, sf_dir):
    return rounded(preprocess.time_series_zscore(_series(spark, sf_dir).select("symbol", "date", "close", "volume"), ["close", "volume"]))


@_query
def ffill(spark, sf_dir):
    holes = F.when(F.day("date") % 3 != 0, F.col("close"))
    return rounded(preprocess.fill_missing(_series(spark, sf_dir).select("symbol", "date", holes.alias("x")), ["x"]))


@_query
def preprocess_panel(spark, sf_dir):
    return rounded(preprocess.preprocess(_features(spark, sf_dir).select("market", "symbol", "date", *FEATURES), FEATURES))


_found["preprocess"] = _found.pop("preprocess_panel")


# ------------------------------------------------------------------ selection and backtest


def _ruled(spark, sf_dir) -> DataFrame:
    bars = factors.pct_change(factors.volume(_series(spark, sf_dir)))
    name = F.when(F.col("symbol").endswith("7"), F.concat(F.lit("ST "), F.col("name"))).otherwise(F.col("name"))
    return bars.withColumn("name", name)


def _with_rules(spark, sf_dir) -> DataFrame:
    return _ruled(spark, sf_dir).join(F.broadcast(views.market_rules(spark)), "market", "left")


@_query
def filter_name_regex(spark, sf_dir):
    return _ruled(spark, sf_dir).where(selection.name_allowed()).select("symbol", "date", "name")


@_query
def filter_min_history(spark, sf_dir):
    return selection.with_history(_ruled(spark, sf_dir)).where("n_bars >= 285").select("symbol", "date", "n_bars")


@_query
def filter_price_limit(spark, sf_dir):
    return rounded(_with_rules(spark, sf_dir).where(selection.within_limit()).select("symbol", "date", "pct_chg"))


@_query
def filter_limit_up(spark, sf_dir):
    return rounded(_ruled(spark, sf_dir).where(selection.not_limit_up()).select("symbol", "date", "pct_chg"))


@_query
def filter_liquidity(spark, sf_dir):
    return rounded(_ruled(spark, sf_dir).where(selection.liquid()).select("symbol", "date", "volume_ratio_5"))


@_query
def filter_min_amount(spark, sf_dir):
    return rounded(_with_rules(spark, sf_dir).where(selection.enough_amount()).select("symbol", "date", "amount"))


@_query
def filter_market(spark, sf_dir):
    return rounded(selection.filter_market(_ruled(spark, sf_dir), views.market_rules(spark)).select("market", "symbol", "date", "pct_chg", "n_bars"))


@_query
def latest_cross_section(spark, sf_dir):
    return rounded(selection.latest(predictions(spark, sf_dir)).select("market", "symbol", "date", "pred_ret"))


@_query
def diversified_topk(spark, sf_dir):
    return rounded(selection.diversified(selection.latest(predictions(spark, sf_dir))).select("market", "symbol", "industry", "pred_ret", "rank"))


@_query
def pick_metrics(spark, sf_dir):
    return rounded(selection.pick_metrics(selection.latest(predictions(spark, sf_dir))))


@_query
def quintiles(spark, sf_dir):
    return rounded(selection.quintiles(predictions(spark, sf_dir)))


@_query
def long_short(spark, sf_dir):
    return rounded(selection.long_short(selection.quintiles(predictions(spark, sf_dir))))


@_query
def topk_daily(spark, sf_dir):
    return rounded(selection.topk_daily(predictions(spark, sf_dir)).select("date", "ret", "n"))


@_query
def cum_returns(spark, sf_dir):
    return rounded(selection.cumulative(selection.topk_daily(predictions(spark, sf_dir))).select("date", "ret", "cum"))


@_query
def sharpe(spark, sf_dir):
    return rounded(selection.backtest(predictions(spark, sf_dir), (10,)).select("sharpe", "n_days"))


@_query
def backtest_topk(spark, sf_dir):
    return rounded(selection.backtest(predictions(spark, sf_dir)))


# ------------------------------------------------------------------ validation and models


@_query
def query_groups(spark, sf_dir):
    return validation.query_groups(views.bars(spark, sf_dir))


@_query
def cv_folds(spark, sf_dir):
    return validation.cv_folds(views.bars(spark, sf_dir))


@_query
def cv_purge_anti(spark, sf_dir):
    rows = validation.purged(views.bars(spark, sf_dir).select("symbol", "date"), seen_dates=1)
    return rows.groupBy("fold", "symbol").agg(F.count(F.lit(1)).alias("n"))


@_query
def wfa_windows(spark, sf_dir):
    return validation.walk_forward(views.bars(spark, sf_dir), TRAIN, STEP)


@_query
def wfa_linear(spark, sf_dir):
    rows = _labelled(spark, sf_dir).where("label IS NOT NULL")
    return rounded(validation.walk_forward_linear(rows, "close_ma_5_ratio", "label", TRAIN, STEP).select("symbol", "date", "start", "pred_ret"))


@_query
def rank_ic(spark, sf_dir):
    return rounded(validation.rank_ic(predictions(spark, sf_dir), ["pred_ret"]))


@_query
def ic_topn(spark, sf_dir):
    ics = validation.rank_ic(_labelled(spark, sf_dir), FEATURES)
    return rounded(ics.orderBy(F.desc(F.abs("ic")), "name").limit(3))


@_query
def ic_report(spark, sf_dir):
    return rounded(validation.ic_report(validation.rank_ic(_labelled(spark, sf_dir), FEATURES)))


@_query
def ic_prune(spark, sf_dir):
    return rounded(validation.prune_by_ic(validation.rank_ic(_labelled(spark, sf_dir), FEATURES), 0.01, 2))


@_query
def ndcg_at_k(spark, sf_dir):
    return rounded(validation.ndcg(predictions(spark, sf_dir)))


@_query
def stack_ridge(spark, sf_dir):
    return rounded(validation.stack_ridge(_labelled(spark, sf_dir), "close_ma_5_ratio", "momentum_10d"))


@_query
def gbt_rank(spark, sf_dir):
    """Trees on the labels' percentiles by date, with the library's settings, judged by NDCG on the last fifth of the dates."""
    rows = _labelled(spark, sf_dir).where("label IS NOT NULL").select("market", "symbol", "date", "label", *FEATURES)
    rows = Tables(spark, "gbt_rank").write(models.with_target(rows), "rows")  # read for the cut, the bins and both sides
    cut = rows.agg(F.percentile_approx(F.unix_date("date"), 0.8).alias("c")).first()["c"]
    if cut is None:
        return spark.createDataFrame([], "date date, ndcg double")
    past, coming = rows.where(F.unix_date("date") <= cut), rows.where(F.unix_date("date") > cut)
    fitted = boosting.boost(past, coming, FEATURES, POINTWISE, boosting.quantile_cuts(past, FEATURES), label="target")
    return validation.ndcg(fitted.predict(coming))


# ------------------------------------------------------------------ text


def _analyzed(spark, sf_dir) -> DataFrame:
    return text.analyzed(views.articles(spark, sf_dir), POSITIVE, NEGATIVE)


@_query
def quick_sentiment(spark, sf_dir):
    return rounded(views.articles(spark, sf_dir).select("seq", text.quick_sentiment(F.col("text"), POSITIVE, NEGATIVE).alias("quick")))


@_query
def keyword_relevance(spark, sf_dir):
    return views.articles(spark, sf_dir).select("seq", text.matches(F.col("text"), WATCHED).cast("long").alias("relevance"))


@_query
def lexicon_boost(spark, sf_dir):
    base = clamp(F.col("score") / 100.0 - 2)
    return rounded(views.articles(spark, sf_dir).select("seq", text.lexicon_boost(F.col("text"), base, POSITIVE, NEGATIVE).alias("boosted")))


@_query
def lexicon_theta_join(spark, sf_dir):
    words = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(s).alias("sign")) for ws, s in ((POSITIVE, 1), (NEGATIVE, -1)) for w in ws))
    low = views.articles(spark, sf_dir).select("market", F.lower("text").alias("low"))
    hits = low.select("market", F.explode(F.filter(words, lambda w: F.contains(F.col("low"), w["word"]))).alias("w"))
    return hits.groupBy("market", F.col("w.word").alias("word"), F.col("w.sign").alias("sign")).agg(F.count(F.lit(1)).alias("n"))


@_query
def analyze_items(spark, sf_dir):
    return rounded(_analyzed(spark, sf_dir).select("seq", "sentiment", "sentiment_label"))


@_query
def article_weight(spark, sf_dir):
    return rounded(views.articles(spark, sf_dir).select("seq", text.article_weight().alias("weight")))


@_query
def extract_tickers(spark, sf_dir):
    found = F.array_join(text.tickers(F.col("text"), F.col("market")), ",")
    return views.articles(spark, sf_dir).select("seq", found.alias("tickers"))


@_query
def listed_symbols(spark, sf_dir):
    every = views.bars(spark, sf_dir).select("market", "symbol").distinct()
    return every.select("market", "symbol", F.when(F.col("market") == "CN", text.listed(F.col("symbol"))).otherwise(F.col("symbol")).alias("listed"))


@_query
def json_ticker_map(spark, sf_dir):
    rows = views.articles(spark, sf_dir).withColumn("json", F.to_json("ticker_sentiments"))
    scored = F.from_json("json", "map<string, struct<score: double, label: string>>")
    rows = rows.withColumn("scored", scored)
    first = F.get(F.map_values("scored"), F.lit(0))
    found = F.array_join(text.all_tickers(F.col("text"), F.col("market"), F.col("scored")), ",")
    return rounded(rows.select("seq", found.alias("tickers"), first["score"].alias("score"), first["label"].alias("label")))


@_query
def resolve_date(spark, sf_dir):
    written = text.first_filled(F.col("published"), F.lit(""))
    return views.articles(spark, sf_dir).select("seq", text.resolved_date(written, F.col("collected_at")).alias("date"))


@_query
def av_timestamp(spark, sf_dir):
    compact = F.when(F.col("seq") % 9 == 0, "2024").otherwise(F.concat(F.lit("202401"), F.lpad((F.col("seq") % 28 + 1).cast("string"), 2, "0"), F.lit("T083015")))
    return views.articles(spark, sf_dir).select("seq", text.compact_to_iso(compact).alias("iso"))


@_query
def url_dedup(spark, sf_dir):
    return text.url_dedup(views.articles(spark, sf_dir).select("seq", "url"))


@_query
def topk_extreme(spark, sf_dir):
    rows = views.articles(spark, sf_dir).select("seq", text.quick_sentiment(F.col("text"), POSITIVE, NEGATIVE).alias("quick"), text.matches(F.col("text"), WATCHED).cast("long").alias("relevance"))
    return rounded(rows.orderBy(F.desc(F.abs(F.round("quick", 6))), F.desc("relevance"), "seq").limit(50))


@_query
def ticker_sentiment(spark, sf_dir):
    return rounded(text.ticker_sentiment(text.by_ticker(_analyzed(spark, sf_dir))))


@_query
def temporal_sentiment(spark, sf_dir):
    return rounded(text.temporal_sentiment(text.by_ticker(_analyzed(spark, sf_dir))))


@_query
def market_sentiment(spark, sf_dir):
    return rounded(text.market_sentiment(_analyzed(spark, sf_dir)))


@_query
def snapshot_score(spark, sf_dir):
    return rounded(text.snapshot_scores(_analyzed(spark, sf_dir)))


@_query
def top_tickers(spark, sf_dir):
    return rounded(text.top_tickers(text.by_ticker(_analyzed(spark, sf_dir))))


@_query
def source_counts(spark, sf_dir):
    return views.articles(spark, sf_dir).groupBy(F.coalesce("source_cn", "source").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@_query
def sentiment_daily(spark, sf_dir):
    return rounded(views.daily_sentiment(spark, sf_dir))


@_query
def sentiment_merge(spark, sf_dir):
    daily = views.daily_sentiment(spark, sf_dir).select("date", "symbol", "sentiment_score", "news_count")
    shifted = daily.where("news_count > 1").withColumn("sentiment_score", F.col("sentiment_score") / 2)
    return rounded(text.merged_daily(daily, shifted))


# ------------------------------------------------------------------ timeline and signals


def _curve(spark, sf_dir, hours: int = 72) -> DataFrame:
    return timeline.hour_dedup(timeline.recent(views.snapshots(spark, sf_dir), views.AS_OF, hours))


@_query
def hour_dedup(spark, sf_dir):
    return rounded(timeline.hour_dedup(views.snapshots(spark, sf_dir)).select("market", "timestamp", "seq", "sentiment_score", "article_count"))


@_query
def recent_hours(spark, sf_dir):
    parts = [timeline.recent(views.snapshots(spark, sf_dir), views.AS_OF, h).groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.avg("sentiment_score").alias("mean")).withColumn("hours", F.lit(h)) for h in (4, 24, 48)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@_query
def poll_gaps(spark, sf_dir):
    return rounded(timeline.gaps(timeline.hour_dedup(views.snapshots(spark, sf_dir))))


@_query
def curve_smooth(spark, sf_dir):
    return rounded(timeline.curve(_curve(spark, sf_dir)).select("market", "seq", "smooth"))


@_query
def curve_features(spark, sf_dir):
    return rounded(timeline.curve(_curve(spark, sf_dir)).select("market", "seq", "trend", "volatility"))


@_query
def curve_snapshot(spark, sf_dir):
    return rounded(timeline.curve_snapshot(_curve(spark, sf_dir, 24)))


@_query
def sentiment_summary(spark, sf_dir):
    return rounded(timeline.summary(_curve(spark, sf_dir, 24)))


@_query
def curve_display(spark, sf_dir):
    return rounded(timeline.display(_curve(spark, sf_dir)))


@_query
def trading_hour(spark, sf_dir):
    return views.snapshots(spark, sf_dir).select("seq", timeline.trading_hour(F.col("timestamp")).alias("trading"))


@_query
def detect_slot(spark, sf_dir):
    return views.snapshots(spark, sf_dir).select("seq", timeline.slot_of(F.col("timestamp")).alias("slot"))


@_query
def signal_stats(spark, sf_dir):
    return rounded(timeline.signal_stats(_curve(spark, sf_dir, 24)))


@_query
def market_signal(spark, sf_dir):
    return rounded(timeline.market_signals(views.snapshots(spark, sf_dir), views.AS_OF, 24).select("market", "signal", "confidence"))


@_query
def slot_0700(spark, sf_dir):
    return rounded(timeline.slot_0700(views.snapshots(spark, sf_dir), views.AS_OF))


@_query
def slot_0925(spark, sf_dir):
    return rounded(timeline.slot_0925(views.snapshots(spark, sf_dir), views.AS_OF))


@_query
def slot_0955(spark, sf_dir):
    return timeline.slot_0955(views.snapshots(spark, sf_dir), views.AS_OF)


@_query
def slot_1330(spark, sf_dir):
    picks = selection.diversified(selection.latest(predictions(spark, sf_dir).where("market = 'CN'")))
    return rounded(timeline.slot_1330(picks, views.snapshots(spark, sf_dir), views.AS_OF).select("symbol", "rank", "pred_ret", "sentiment_signal", "action", "published"))


@_query
def yesterday_buys(spark, sf_dir):
    return timeline.yesterday_buys(views.journal(spark, sf_dir), TODAY).select("entry_date", "seq", "top_symbol", F.get_json_object("payload", "$.pick").alias("pick"))


@_query
def slot_status(spark, sf_dir):
    return timeline.slot_status(views.journal(spark, sf_dir), TODAY, STATUS_HOUR)


def _written(query: Query) -> Query:
    """The query with dates and times as text, which every reader compares alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        forms = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
        return df.select(*(F.date_format(c, forms[kind]).alias(c) if kind in forms else F.col(c) for c, kind in df.dtypes))

    return run


def queries() -> dict[str, Query]:
    from quantloom.plans import fitting, flow  # which build on the queries here

    return {name: _written(query) for name, query in (_found | flow.queries() | fitting.queries()).items()}
