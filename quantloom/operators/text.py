"""Scoring of articles and posts: lexicons, tickers, dates, weights and their aggregates.

All of it is native expressions over literal arrays; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import clamp
from quantloom.operators.timeline import trading_hour

# The financial lexicons, the quick lexicons, the symbols and the names that results depend on.
CN_POSITIVE = [
    "涨停", "大涨", "暴涨", "飙升", "突破", "利好", "牛市", "反弹", "反转", "回暖", "攀升", "强势", "超预期", "创新高", "放量上涨", "触底反弹", "企稳回升", "业绩大增", "扭亏为盈", "分红", "回购", "评级上调",
    "买入", "增持", "优质", "龙头",
]
CN_NEGATIVE = [
    "跌停", "大跌", "暴跌", "跳水", "崩盘", "利空", "熊市", "亏损", "减持", "卖出", "评级下调", "ST", "退市", "违约", "爆仓", "恐慌", "抛售", "破位", "下行", "低迷", "利空出尽", "业绩预亏", "商誉减值",
    "立案调查", "监管处罚",
]
EN_POSITIVE = [
    "beat", "earnings beat", "outperform", "upgrade", "buy", "bullish", "positive guidance", "record high", "rally", "surge", "breakout", "recovery",
    "momentum", "growth", "dividend increase", "buyback", "strong quarter", "raised guidance", "overweight", "market leader",
]
EN_NEGATIVE = [
    "miss", "earnings miss", "downgrade", "sell", "bearish", "negative guidance", "crash", "plunge", "loss", "decline", "recession", "default",
    "bankruptcy", "selloff", "underperform", "underweight", "restructuring", "layoff", "investigation", "regulatory action",
]
QUICK_CN_POSITIVE = [
    "利好", "大涨", "牛市", "突破", "反弹", "涨停", "增长", "创新高", "超预期", "放量大涨", "飙升", "逆转", "回暖", "攀升", "强势",
]
QUICK_CN_NEGATIVE = [
    "利空", "大跌", "熊市", "暴跌", "跌停", "风险", "亏损", "减持", "利空出尽", "恐慌", "抛售", "破位", "下行", "低迷", "崩盘",
]
QUICK_EN_POSITIVE = [
    "rally", "surge", "breakout", "bullish", "upgrade", "beat", "growth", "record high", "positive", "outperform", "boom", "recovery", "momentum",
    "soar", "jump",
]
QUICK_EN_NEGATIVE = [
    "crash", "plunge", "bearish", "downgrade", "miss", "loss", "decline", "recession", "negative", "slump", "tumble", "selloff", "downturn",
    "default", "bankruptcy",
]
US_SYMBOLS = [
    "AAPL", "MSFT", "GOOGL", "GOOG", "AMZN", "NVDA", "TSLA", "META", "AVGO", "JPM", "V", "BAC", "WMT", "JNJ", "PG", "XOM", "CVX", "UNH", "HD", "DIS",
    "MA", "NFLX", "ADBE", "CRM", "INTC", "AMD", "PYPL", "BABA", "JD", "NIO", "TSM", "SPY", "QQQ", "DIA", "IWM", "VIX", "KWEB", "FXI", "EWJ", "EWY",
]
CN_NAMES = {
    "贵州茅台": "600519.SS",
    "五粮液": "000858.SZ",
    "宁德时代": "300750.SZ",
    "中国平安": "601318.SS",
    "招商银行": "600036.SS",
    "美的集团": "000333.SZ",
    "格力电器": "000651.SZ",
    "恒瑞医药": "600276.SS",
    "药明康德": "603259.SS",
    "隆基绿能": "601012.SS",
    "比亚迪": "002594.SZ",
    "迈瑞医疗": "300760.SZ",
    "海康威视": "002415.SZ",
    "中芯国际": "688981.SS",
    "立讯精密": "002475.SZ",
    "东方财富": "300059.SZ",
    "中信证券": "600030.SS",
    "工商银行": "601398.SS",
    "农业银行": "601288.SS",
    "建设银行": "601939.SS",
}


def _array(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def matches(text: Column, words, fold: bool = True) -> Column:
    """How many of the words the text contains; each counts once, overlaps too."""
    text = F.lower(text) if fold else text
    return F.size(F.filter(_array([w.lower() for w in words] if fold else words), lambda w: F.contains(text, w)))


def quick_sentiment(text: Column, positive=QUICK_EN_POSITIVE, negative=QUICK_EN_NEGATIVE) -> Column:
    return clamp((matches(text, positive) - matches(text, negative)) * 0.15)


def quick_sentiment_of(text: Column, market: Column) -> Column:
    return F.when(market == "CN", quick_sentiment(text, QUICK_CN_POSITIVE, QUICK_CN_NEGATIVE)).otherwise(quick_sentiment(text))


def lexicon_boost(text: Column, base: Column, positive=EN_POSITIVE, negative=EN_NEGATIVE, fold: bool = True) -> Column:
    """base moved by 0.08 a term, by 0.5 at most."""
    moved = (matches(text, positive, fold) - matches(text, negative, fold)) * 0.08
    return clamp(base + clamp(moved, -0.5, 0.5))


def lexicon_boost_of(text: Column, market: Column, base: Column) -> Column:
    """The market's lexicon; Chinese terms are matched as written."""
    return F.when(market == "CN", lexicon_boost(text, base, CN_POSITIVE, CN_NEGATIVE, fold=False)).otherwise(lexicon_boost(text, base))


def analyzed(articles: DataFrame, positive=EN_POSITIVE, negative=EN_NEGATIVE, base: Column | None = None) -> DataFrame:
    """Adds full_text, sentiment and sentiment_label (null for empty text).

    ``base`` is the score of another model; without one it is 0.
    """
    text = F.trim(F.concat_ws(" ", "text", "comments_text"))
    raw = lexicon_boost(F.col("full_text"), base if base is not None else F.lit(0.0), positive, negative)
    damped = F.when(F.col("followers") > 10000, F.col("_raw") * 0.8 + F.col("_raw") * F.least(F.col("followers") / 1e6, F.lit(0.2))).otherwise(F.col("_raw"))
    empty = F.length("full_text") == 0
    label = F.when(F.col("_score") >= 0.35, "positive").when(F.col("_score") <= -0.35, "negative").otherwise("neutral")
    out = articles.withColumn("full_text", text).withColumn("_raw", raw).withColumn("_score", damped)
    out = out.withColumns({"sentiment": F.when(empty, 0.0).otherwise(clamp("_score")), "sentiment_label": F.when(~empty, label)})
    return out.drop("_raw", "_score")


def article_weight() -> Column:
    """Weight by type, followers and engagement."""
    base = F.when(F.col("type") == "api", 1.2).when(F.col("type") == "social", 0.6).otherwise(1.0)
    followers = F.when(F.col("followers") > 100000, 1.5).when(F.col("followers") > 10000, 1.2).otherwise(1.0)
    engagement = sum((F.coalesce(F.col(c), F.lit(0)) * n for c, n in (("likes", 1), ("comments", 3), ("score", 1))), F.coalesce(F.col("retweets"), F.lit(0)) * 2)
    return base * followers * F.when(engagement > 1000, F.least(F.lit(1.5), 1 + engagement / 10000)).otherwise(1.0)


def listed(code: Column) -> Column:
    """A six-digit code with its exchange, the form that tickers found in texts have; others as they are."""
    return F.when(code.rlike(r"^\d{6}$"), F.concat(code, F.when(F.substring(code, 1, 2).isin("00", "30"), ".SZ").otherwise(".SS"))).otherwise(code)


def tickers(text: Column, market: Column) -> Column:
    """Tickers in the order found, each once."""
    codes = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])(\d{6})(?![\p{L}\p{N}_])"), F.lit(1))
    names = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(t).alias("t")) for n, t in CN_NAMES.items())), lambda x: F.contains(text, x["n"]))
    chinese = F.array_distinct(F.concat(F.transform(codes, listed), F.transform(names, lambda x: x["t"])))
    marked = F.regexp_extract_all(text, F.lit(r"\$([A-Z]{1,5})\b"), F.lit(1))
    bare = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{1,5})\b"), F.lit(1)), lambda w: w.isin(US_SYMBOLS))
    return F.when(market == "CN", chinese).otherwise(F.array_distinct(F.concat(marked, bare)))


def all_tickers(text: Column, market: Column, scored: Column) -> Column:
    """Tickers of the text, then those that the provider names."""
    return F.array_union(tickers(text, market), F.coalesce(F.map_keys(scored), F.array().cast("array<string>")))


_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd'T'HHmmss", "yyyyMMdd")


def resolved_date(published: Column, collected: Column) -> Column:
    """The date of the first 19 characters in a known form, else an ISO prefix, else when collected."""
    head = F.substring(published, 1, 19)
    parsed = [F.date_format(F.try_to_timestamp(head, F.lit(f)), "yyyy-MM-dd") for f in _FORMATS]
    iso = F.when(F.substring(published, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(published, 1, 10))
    return F.coalesce(*parsed, iso, F.substring(collected, 1, 10))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def compact_to_iso(ts: Column) -> Column:
    """20240131T083000 as 2024-01-31T08:30:00; shorter than 8 characters as it is."""
    part = lambda at, n: F.substring(ts, at, n)
    date = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))
    full = F.concat(date, F.lit("T"), F.concat_ws(":", part(10, 2), part(12, 2), part(14, 2)))
    return F.when(F.length(ts) < 8, ts).when(F.length(ts) >= 15, full).otherwise(date)


def url_dedup(articles: DataFrame) -> DataFrame:
    """The first article of each URL; without URL all stay, and are not shuffled together."""
    with_url = articles.where("url != ''").withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("seq"))).where("_n = 1").drop("_n")
    return with_url.unionByName(articles.where("url = '' OR url IS NULL"))


def by_ticker(articles: DataFrame, listed_only: DataFrame | None = None) -> DataFrame:
    """One row a ticker of an analyzed article, with weight and date.

    With ``listed_only`` (column ticker) only those tickers count; it may be of any size.
    """
    rows = articles.withColumns(
        {"ticker": F.explode(all_tickers(F.col("full_text"), F.col("market"), F.col("ticker_sentiments"))), "weight": article_weight(), "date": resolved_date(F.col("published"), F.col("collected_at"))}
    )
    rows = rows.select("seq", "market", "date", "ticker", "sentiment", "weight")
    return rows if listed_only is None else rows.join(listed_only.select("ticker"), "ticker", "left_semi")


def ticker_sentiment(rows: DataFrame, key: str = "ticker") -> DataFrame:
    s = F.col("sentiment")
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    weighted = F.when(F.sum("weight") > 0, F.sum(s * F.col("weight")) / F.sum("weight")).otherwise(0.0)
    return rows.groupBy(key).agg(
        weighted.alias("sentiment_score"),
        F.count(s).alias("news_count"),
        F.stddev_pop(s).alias("sentiment_std"),
        share(s > 0.15).alias("positive_share"),
        share(s < -0.15).alias("negative_share"),
        share((s >= -0.15) & (s <= 0.15)).alias("neutral_share"),
    )


def temporal_sentiment(rows: DataFrame, *keys: str) -> DataFrame:
    s = F.col("sentiment")
    return rows.groupBy(*(keys or ("date", "ticker"))).agg(F.avg(s).alias("sentiment_score"), F.count(s).alias("news_count"), F.stddev_pop(s).alias("sentiment_std"), F.max(s).alias("max_score"), F.min(s).alias("min_score"))


def market_sentiment(articles: DataFrame) -> DataFrame:
    weighted = articles.withColumn("_w", article_weight()).groupBy("market").agg(F.sum(F.col("sentiment") * F.col("_w")).alias("s"), F.sum("_w").alias("w"), F.count(F.lit(1)).alias("n"))
    return weighted.select("market", F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0).alias("market_score"), "n")


def snapshot_scores(articles: DataFrame) -> DataFrame:
    """Mean of a market's (date, ticker) rows, else the weighted mean of its articles."""
    daily = temporal_sentiment(by_ticker(articles), "market", "date", "ticker").groupBy("market").agg(F.avg("sentiment_score").alias("daily"))
    return market_sentiment(articles).join(daily, "market", "left").select("market", F.coalesce("daily", "market_score").alias("snapshot_score"))


def top_tickers(rows: DataFrame, k: int = 10) -> DataFrame:
    scored = temporal_sentiment(rows, "market", "ticker").select("market", "ticker", F.round("sentiment_score", 9).alias("sentiment_score"), "news_count")
    order = Window.partitionBy("market").orderBy(F.desc(F.abs("sentiment_score")), "ticker")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def snapshot(articles: DataFrame, as_of: str, failures: DataFrame | None = None) -> DataFrame:
    """One row a market of analyzed articles: score, articles, their sources, strongest tickers, trading hour.

    Counts by source and tickers are JSON, as the timeline keeps them.  Of ``failures``, market
    and error, each market without articles has one row, with score 0 and its errors.
    """
    sources = articles.groupBy("market", F.coalesce("source_cn", "source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    by_source = F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n"))))
    sources = sources.where("source IS NOT NULL").groupBy("market").agg(F.to_json(by_source).alias("source_counts"))
    best = F.sort_array(F.collect_list(F.struct("rank", F.struct("ticker", F.round("sentiment_score", 4).alias("score"), F.col("news_count").alias("count")).alias("t"))))
    tops = top_tickers(by_ticker(articles)).groupBy("market").agg(F.to_json(F.transform(best, lambda x: x["t"])).alias("top_tickers"))
    rows = snapshot_scores(articles).join(articles.groupBy("market").agg(F.count(F.lit(1)).alias("article_count")), "market").join(sources, "market", "left").join(tops, "market", "left")
    rows = rows.withColumn("error", F.lit(None).cast("string"))
    if failures is not None:
        failed = failures.groupBy("market").agg(F.array_join(F.sort_array(F.collect_set("error")), "; ").alias("error"))
        failed = failed.join(rows.select("market"), "market", "left_anti").withColumns({"snapshot_score": F.lit(0.0), "article_count": F.lit(0).cast("long")})
        rows = rows.unionByName(failed, allowMissingColumns=True)
    now = F.lit(as_of).cast("timestamp")
    return rows.select(
        now.alias("timestamp"),
        "market",
        F.round("snapshot_score", 4).alias("sentiment_score"),
        "article_count",
        F.coalesce("source_counts", F.lit("{}")).alias("source_counts"),
        F.coalesce("top_tickers", F.lit("[]")).alias("top_tickers"),
        trading_hour(now).alias("is_trading_hour"),
        "error",
    )


def links(pages: DataFrame, most: int = 50) -> DataFrame:
    """page_id, pos, href, anchor of the first links of each page."""
    pattern = r'<a href="([^"]*)">([^<]*)</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("anchor"))
    rows = pages.select("page_id", F.posexplode(F.slice(both, 1, most)).alias("pos", "link"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("link.href").alias("href"), F.col("link.anchor").alias("anchor")).where("length(trim(anchor)) > 0")


def capped(rows: DataFrame, key: str, most: int, *order) -> DataFrame:
    """At most so many rows of each key, a quota."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def merged_daily(*tables: DataFrame) -> DataFrame:
    """Daily tables put together: means of means and sums of counts."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("date", "symbol").agg(F.avg("sentiment_score").alias("sentiment_score"), F.sum("news_count").alias("news_count"))
