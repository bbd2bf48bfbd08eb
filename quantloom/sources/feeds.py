"""Raw responses of providers, one a row, as the engine's articles, daily scores and bars.

Collectors put each response into a table with its body; what is here is the part after
that, all of it native expressions.  A body that does not parse has no items, and a
number that does not parse is 0, so one bad response costs nothing but itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.session import Tables
from quantloom.operators.text import compact_to_iso, matches, quick_sentiment_of

# The fields that responses name, the headers of daily bars, and lengths.
SCORED_BODY = (
    "feed array<struct<title: string, summary: string, url: string, time_published: string, overall_sentiment_score: string, overall_sentiment_label: string,"
    " relevance_score: string, ticker_sentiment: array<struct<ticker: string, ticker_sentiment_score: string, ticker_sentiment_label: string>>>>"
)
NEWS_BODY = "articles array<struct<title: string, description: string, url: string, publishedAt: string, source: struct<name: string>>>"
ENTITY_BODY = (
    "data array<struct<title: string, description: string, url: string, published_at: string, sentiment: string, sentiment_score: string,"
    " entities: array<struct<symbol: string, type: string>>>>"
)
BAR_HEADERS = {
    "日期": "date",
    "开盘": "open",
    "收盘": "close",
    "最高": "high",
    "最低": "low",
    "成交量": "volume",
    "成交额": "amount",
    "振幅": "amplitude",
    "涨跌幅": "pct_chg",
    "涨跌额": "change",
    "换手率": "turnover",
}
SUMMARY, TEXT, TITLE, TABLE_ROWS = 500, 2000, 200, 50

#: Columns of an article, in order; a provider that lacks one leaves it null.
ARTICLE = {
    "source": "string",
    "source_cn": "string",
    "source_name": "string",
    "type": "string",
    "title": "string",
    "summary": "string",
    "url": "string",
    "published": "string",
    "text": "string",
    "sentiment": "double",
    "sentiment_label": "string",
    "relevance": "double",
    "language": "string",
    "market": "string",
    "collected_at": "string",
    "followers": "long",
    "retweets": "long",
    "likes": "long",
    "comments": "long",
    "score": "long",
    "ticker_sentiments": "map<string, struct<score: double, label: string>>",
    "entities": "array<struct<symbol: string, type: string>>",
}


def _article(rows: DataFrame, **given: Column) -> DataFrame:
    """The given columns in the order and types of an article."""
    return rows.select(*(given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in ARTICLE.items()))


def _or_empty(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(""))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def _items(raw: DataFrame, schema: str, field: str) -> DataFrame:
    return raw.withColumn("item", F.explode(F.from_json("body", schema)[field]))


def _language(market: Column) -> Column:
    return F.when(market == "CN", "zh").otherwise("en")


def _ticker_map(tickers: Column) -> Column:
    """ticker -> (score, label); of a ticker that comes twice the last one counts."""
    tickers = F.coalesce(tickers, F.array().cast("array<struct<ticker: string, ticker_sentiment_score: string, ticker_sentiment_label: string>>"))
    named = F.transform(
        tickers,
        lambda t: F.struct(
            _or_empty(t["ticker"]).alias("key"),
            F.struct(_number(t["ticker_sentiment_score"]).alias("score"), F.coalesce(t["ticker_sentiment_label"], F.lit("Neutral")).alias("label")).alias("value"),
        ),
    )
    last = F.filter(named, lambda t, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda u: u["key"] == t["key"]))
    return F.map_from_entries(last)


def scored_articles(raw: DataFrame, source: str = "alpha_vantage", shown: str = "Alpha Vantage") -> DataFrame:
    """Articles of responses (market, collected_at, body) whose items carry scores for each ticker."""
    rows = _items(raw, SCORED_BODY, "feed")
    of = lambda name: F.col("item")[name]
    title, summary = _or_empty(of("title")), _or_empty(of("summary"))
    return _article(
        rows,
        source=F.lit(source),
        source_cn=F.lit(shown),
        type=F.lit("api"),
        title=title,
        summary=F.substring(summary, 1, SUMMARY),
        url=_or_empty(of("url")),
        published=compact_to_iso(_or_empty(of("time_published"))),
        text=F.substring(F.concat(title, F.lit(" "), summary), 1, TEXT),
        sentiment=_number(of("overall_sentiment_score")),
        sentiment_label=F.coalesce(of("overall_sentiment_label"), F.lit("Neutral")),
        relevance=_number(of("relevance_score")),
        language=F.lit("en"),
        market=F.col("market"),
        collected_at=F.col("collected_at"),
        ticker_sentiments=_ticker_map(of("ticker_sentiment")),
    )


def news_articles(
    raw: DataFrame, watched: Sequence[str] = (), scorer: Callable[[Column, Column], Column] = quick_sentiment_of, source: str = "newsapi", shown: str = "NewsAPI"
) -> DataFrame:
    """Articles of plain news responses; scored by words and by how many watched words they hold."""
    rows = _items(raw, NEWS_BODY, "articles")
    title, about = (_strip(_or_empty(F.col("item")[name])) for name in ("title", "description"))
    rows = rows.withColumns({"_title": title, "_about": about}).withColumn("_text", _strip(F.concat("_title", F.lit(" "), "_about"))).where("_text != ''")
    return _article(
        rows,
        source=F.lit(source),
        source_cn=F.lit(shown),
        source_name=_or_empty(F.col("item")["source"]["name"]),
        type=F.lit("api"),
        title=F.col("_title"),
        summary=F.substring("_about", 1, SUMMARY),
        url=_or_empty(F.col("item")["url"]),
        published=_or_empty(F.col("item")["publishedAt"]),
        text=F.substring("_text", 1, TEXT),
        sentiment=scorer(F.col("_text"), F.col("market")),
        relevance=matches(F.col("_text"), watched),
        language=_language(F.col("market")),
        market=F.col("market"),
        collected_at=F.col("collected_at"),
    )


def entity_articles(raw: DataFrame, source: str = "marketaux", shown: str = "MarketAux") -> DataFrame:
    """Articles of responses with one score and the entities of each item; no score is 0."""
    rows = _items(raw, ENTITY_BODY, "data")
    title, about = (_strip(_or_empty(F.col("item")[name])) for name in ("title", "description"))
    rows = rows.withColumns({"_title": title, "_about": about}).withColumn("_text", _strip(F.concat("_title", F.lit(" "), "_about"))).where("_text != ''")
    return _article(
        rows,
        source=F.lit(source),
        source_cn=F.lit(shown),
        type=F.lit("api"),
        title=F.col("_title"),
        summary=F.substring("_about", 1, SUMMARY),
        url=_or_empty(F.col("item")["url"]),
        published=_or_empty(F.col("item")["published_at"]),
        text=F.substring("_text", 1, TEXT),
        sentiment=_number(F.col("item")["sentiment"]),
        language=F.lit("en"),
        market=F.col("market"),
        collected_at=F.col("collected_at"),
        entities=F.col("item")["entities"],
    )


def table_articles(pages: DataFrame, scorer: Callable[[Column, Column], Column] = quick_sentiment_of, source: str = "finviz", shown: str = "Finviz") -> DataFrame:
    """Articles of the rows of news tables in pages (market, collected_at, html): time, other, headline with link."""
    tables = F.regexp_extract_all("html", F.lit(r'(?is)<table[^>]*class="(?:[^"]*\s)?news(?:\s[^"]*)?"[^>]*>(.*?)</table>'), F.lit(1))
    lines = F.flatten(F.transform(tables, lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))))
    rows = pages.withColumn("_row", F.explode(F.slice(lines, 1, TABLE_ROWS)))
    rows = rows.withColumn("_cells", F.regexp_extract_all("_row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))).where("size(_cells) >= 3")
    headline = _shown(F.get("_cells", F.lit(2)))
    rows = rows.withColumn("_headline", headline).where("_headline != ''")
    return _article(
        rows,
        source=F.lit(source),
        source_cn=F.lit(shown),
        type=F.lit("scraper"),
        title=F.col("_headline"),
        summary=F.lit(""),
        url=F.regexp_extract(F.get("_cells", F.lit(2)), r'(?is)<a\s[^>]*href="([^"]*)"', 1),
        published=_shown(F.get("_cells", F.lit(0))),
        text=F.substring("_headline", 1, TEXT),
        sentiment=scorer(F.col("_headline"), F.col("market")),
        language=F.lit("en"),
        market=F.col("market"),
        collected_at=F.col("collected_at"),
    )


def _shown(html: Column) -> Column:
    """What is left of a cell without its tags, each piece stripped."""
    out = _strip(F.regexp_replace(html, r"(?s)\s*<[^>]*>\s*", ""))
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def social_articles(posts: DataFrame, source: str, shown: str | Column, market: str | None = None) -> DataFrame:
    """Articles of posts (content, url, published, market, collected_at and, where known, engagement).

    Posts without content go.  ``market`` is that of all posts of a source that has one market.
    """
    counts = {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("followers", "retweets", "likes", "comments", "score") if c in posts.columns}
    place = F.lit(market) if market else F.col("market")
    return _article(
        posts.where("content != ''"),
        source=F.lit(source),
        source_cn=F.lit(shown),
        type=F.lit("social"),
        title=F.substring("content", 1, TITLE),
        text=F.substring("content", 1, TEXT),
        url=_or_empty("url"),
        published=_or_empty("published"),
        sentiment=F.lit(0.0),
        language=F.col("language") if "language" in posts.columns else _language(place),
        market=place,
        collected_at=F.col("collected_at"),
        **counts,
    )


#: Networks by their share of a limit, with their markets and the market that all their posts count for.
NETWORKS = {"twitter": ("Twitter", 2, None, None), "weibo": ("Weibo", 4, ("CN", "JP"), None), "reddit": ("Reddit", 4, None, "US"), "telegram": ("Telegram", 4, None, None)}


def network_articles(posts: DataFrame) -> DataFrame:
    """Articles of the posts of all networks (column network and those of ``social_articles``)."""
    out = None
    for name, (shown, _, markets, market) in NETWORKS.items():
        own = posts.where(F.col("network") == name)
        own = social_articles(own if markets is None else own.where(F.col("market").isin(*markets)), name, shown, market)
        out = own if out is None else out.unionByName(own)
    return out


def social_mix(articles: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` posts, and of each network its share of that: half for the first, a quarter for others."""
    place = F.array_position(F.array(*map(F.lit, NETWORKS)), F.col("source"))
    quota = F.element_at(F.array(*(F.lit(max(1, limit // share)) for _, share, _, _ in NETWORKS.values())), F.greatest(place, F.lit(1)).cast("int"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("likes"), "url"))
    rows = articles.withColumns({"_place": place, "_nth": nth}).where((F.col("_place") > 0) & (F.col("_nth") <= quota))
    return rows.orderBy("_place", "_nth").limit(limit).drop("_place", "_nth")


#: The communities of Reddit, and of Telegram by market, that are read.
SUBREDDITS = ["wallstreetbets", "stocks", "investing", "stockmarket"]
CHANNELS = {"CN": ["A股情报", "财经早报", "股票交流"], "US": ["stockmarketnews", "wallstreetbets", "cryptomarket"]}
OTHER_CHANNELS = ["financialnews"]


def community_articles(posts: DataFrame, limit: int, order: Sequence[str | Column] = ()) -> DataFrame:
    """Articles of the posts (network, market, community, and those of ``social_articles``) of communities that are read.

    A limit is shared alike among a network's communities, those of Telegram in each market;
    the first posts in ``order`` count (without one the latest as published, ties by URL), and those without content take their place but go.
    """
    lists = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in CHANNELS.items() for x in pair))
    of_market = F.coalesce(F.try_element_at(lists, "market"), F.array(*map(F.lit, OTHER_CHANNELS)))
    found = None
    for network, listed, keys, before, market in (
        ("reddit", F.array(*map(F.lit, SUBREDDITS)), ["community"], "r/", "US"),
        ("telegram", of_market, ["market", "community"], "Telegram/", None),
    ):
        own = posts.where((F.col("network") == network) & F.array_contains(listed, F.col("community")))
        first = Window.partitionBy(*keys).orderBy(*(order or (F.desc("published"), "url", "content")))
        quota = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.size(listed)))
        # The fixed bound lets Spark keep so many rows a task before it shuffles them.
        own = own.withColumn("_nth", F.row_number().over(first)).where((F.col("_nth") <= max(1, limit)) & (F.col("_nth") <= quota))
        rows = social_articles(own, network, F.concat(F.lit(before), F.col("community")), market)
        found = rows if found is None else found.unionByName(rows)
    return found


def sources_for(sources: DataFrame, market: str) -> DataFrame:
    """The enabled feeds (source, language, enabled) that a market reads, by language."""
    rows = sources.where("enabled")
    if market == "CN":
        return rows.where("language = 'zh'")
    return rows if market == "JP" else rows.where("language IN ('en', 'kr', 'jp')")


def fan_out(spark: SparkSession, providers: Mapping[str, Callable[[], DataFrame]], limit: int) -> DataFrame:
    """The strongest articles of all providers, with an ``error`` column.

    A provider that fails blocks no other, whether its plan cannot be made or its rows cannot
    be read: each provider's strongest rows are written on their own before they are put
    together.  One that fails leaves one row, with its name and its error.
    """
    tables, found, failed = Tables(spark, "fan-out"), None, []
    for number, (name, fetch) in enumerate(providers.items()):
        try:
            rows = tables.write(strongest(fetch().select(*ARTICLE), limit), f"provider_{number}")
        except ImportError:
            raise
        except Exception as error:  # whatever else a provider raises is its own
            failed.append((name, _reason(error)))
            continue
        found = rows if found is None else found.unionByName(rows)
    errors = spark.createDataFrame(failed, "source string, error string")
    if found is None:
        return _failed(errors)
    return strongest(found, limit).withColumn("error", F.lit(None).cast("string")).unionByName(_failed(errors))


def _reason(error: Exception) -> str:
    """The error in one line; of one that a task raised in Python, the task's own last line."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    own = [x for x in lines if re.match(r"[\w.]+(Error|Exception): ", x)]
    if isinstance(error, PySparkException) and own:
        return own[0]
    return f"{type(error).__name__}: {lines[0] if lines else ''}"


def _failed(errors: DataFrame) -> DataFrame:
    return errors.select(*(F.col(name) if name == "source" else F.lit(None).cast(kind).alias(name) for name, kind in ARTICLE.items()), "error")


def strongest(articles: DataFrame, limit: int) -> DataFrame:
    """The articles with the strongest scores of all providers; ties by URL and title."""
    return articles.orderBy(F.desc(F.abs("sentiment")), "url", "title").limit(limit)


def scored_daily(raw: DataFrame) -> DataFrame:
    """date, symbol, sentiment_score, news_count of scored responses (symbol, body); items without a date go."""
    item = F.col("item")
    rows = _items(raw, SCORED_BODY, "feed").select("symbol", F.try_to_timestamp(F.substring(item["time_published"], 1, 8), F.lit("yyyyMMdd")).cast("date").alias("date"), _number(item["overall_sentiment_score"]).alias("s"))
    return _daily(rows)


def entity_daily(raw: DataFrame) -> DataFrame:
    """As ``scored_daily`` of entity responses, by the first ten characters of the time."""
    item = F.col("item")
    rows = _items(raw, ENTITY_BODY, "data").select("symbol", F.try_to_timestamp(F.substring(item["published_at"], 1, 10), F.lit("yyyy-MM-dd")).cast("date").alias("date"), _number(item["sentiment_score"]).alias("s"))
    return _daily(rows)


def _daily(rows: DataFrame) -> DataFrame:
    return rows.where("date IS NOT NULL").groupBy("date", "symbol").agg(F.avg("s").alias("sentiment_score"), F.count("s").alias("news_count"))


def daily_records(records: DataFrame) -> DataFrame:
    """date, symbol, sentiment_score, news_count of records whose values are text; without a date or symbol they go.

    A score that does not parse is 0, a count that does not parse 1.
    """
    rows = records.select(
        F.try_to_timestamp(F.substring("date", 1, 10), F.lit("yyyy-MM-dd")).cast("date").alias("date"),
        F.nullif(F.trim("symbol"), F.lit("")).alias("symbol"),
        _number(F.col("sentiment_score")).alias("sentiment_score"),
        F.coalesce(F.col("news_count").try_cast("long"), F.lit(1).cast("long")).alias("news_count"),
    )
    return rows.where("date IS NOT NULL AND symbol IS NOT NULL")


def named_bars(bars: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    """Daily bars under the engine's names; moves come in percent and become fractions."""
    out = bars.withColumnsRenamed(headers or BAR_HEADERS).withColumn("date", F.col("date").cast("date"))
    return out.withColumn("pct_chg", F.col("pct_chg") / 100) if "pct_chg" in out.columns else out


def long_bars(wide: DataFrame, symbols: Sequence[str], fields: Sequence[str] = ("open", "high", "low", "close", "volume"), between: str = "_") -> DataFrame:
    """One row for each date and symbol from columns such as AAPL_close; rows without any value go."""
    names = {c.lower(): c for c in wide.columns}

    def value(symbol: str, field: str) -> Column:
        own = names.get(f"{symbol}{between}{field}".lower())
        return (F.col(f"`{own}`") if own else F.lit(None)).cast("double").alias(field)

    rows = wide.select(F.col("date").cast("date").alias("date"), F.inline(F.array(*(F.struct(F.lit(s).alias("symbol"), *(value(s, f) for f in fields)) for s in symbols))))
    return rows.dropna("all", subset=list(fields))
