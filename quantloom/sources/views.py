"""The engine's tables, derived from the star schema: bars, macro, articles, snapshots and more.

Each function takes (spark, sf_dir) and returns a lazy DataFrame with a fixed schema, so
that filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.expr import clamp
from quantloom.functions.session import dealt

#: The moment that operators take for now.
AS_OF = "2024-01-31 00:00:00"
MARKETS = ("CN", "US", "KR", "JP", "US")  # by region key
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
MACRO = ("urgent", "high", "medium", "unspecified", "low")
TICKERS = ("$AAPL", "$MSFT", "$TSLA", "$NVDA", "V", "AMZN")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly open, high, low, close and volume for each supplier as a symbol.

    Prices are aggregated before the dimensions are joined, so only one row for each
    (supplier, week) meets them.  Lines are dealt by supplier first: a week has about two, so sums
    of each input split would hold nearly all of its rows in memory, and those of a fixed number of
    tasks grow with the table.  The join finds the rows as it needs them.
    """
    px = F.col("l_extendedprice") / F.col("l_quantity")
    # A line's place in its week as one long: day, order (40 bits), line (4) and, should a line
    # come twice, the end of its part's number.  Buffers of fixed width keep the aggregate hashed.
    at = F.shiftleft(F.weekday("l_shipdate").cast("long"), 60)
    for column, low, bits in (("l_orderkey", 20, 40), ("l_linenumber", 16, 4), ("l_partkey", 0, 16)):
        at = at + F.shiftleft(F.col(column).cast("long").bitwiseAND(F.lit((1 << bits) - 1)), low)
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select(
        "l_suppkey",
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"),
        px.alias("px"),
        at.alias("at"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
    )
    weekly = dealt(lines, "l_suppkey").groupBy("l_suppkey", "date").agg(
        F.min_by("px", "at").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "at").alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.round(F.sum("l_extendedprice"), 2).alias("amount"),
        F.round(F.sum("l_discount"), 2).alias("turnover"),
    )
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("industry"), _pick(MARKETS, F.col("n_regionkey")).alias("market")
    )
    symbols = table(spark, sf_dir, "supplier").join(F.broadcast(nations), "s_nationkey")  # nations: a fixed 25 rows
    symbols = symbols.select("s_suppkey", F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), F.col("s_name").alias("name"), "industry", "market")
    return weekly.join(symbols, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "market", "symbol", "name", "industry", "date", "open", "high", "low", "close", "volume", "amount", "turnover"
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a week with a column for each series."""
    weeks = table(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"), "o_orderpriority", "o_totalprice")
    wide = weeks.groupBy("date").pivot("o_orderpriority", list(PRIORITIES)).agg(F.round(F.sum("o_totalprice"), 2))
    return wide.toDF("date", *MACRO)


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code (six digits), name and weight (share of all balances) of the constituents."""
    supplier = table(spark, sf_dir, "supplier")
    total = supplier.agg(F.sum("s_acctbal").alias("total"))
    return supplier.crossJoin(F.broadcast(total)).select(  # one row
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"),
        F.col("s_name").alias("name"),
        F.round(F.try_divide("s_acctbal", "total"), 8).alias("weight"),
    )


def market_rules(spark: SparkSession) -> DataFrame:
    """Trading rules by market; amounts are scaled to the weekly bars."""
    rows = [("CN", 0.10, 1, 30000.0, True, True), ("US", None, 1, 20000.0, False, None), ("KR", 0.30, 2, 50000.0, False, None), ("JP", 0.20, 2, 30000.0, False, None)]
    return spark.createDataFrame(rows, "market string, price_limit double, t_plus int, min_amount double, st_filter boolean, limit_up_filter boolean")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News and posts in one schema, with dates in several written forms."""
    d = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (d % 30).cast("int"))
    kind = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 3
    form = d % 6
    published = (
        F.when(form == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(form == 1, F.date_format(day, "yyyyMMdd"))
        .when(form == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T08:30:00")))
        .when(form == 3, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 17:05:59")))
        .when(form == 4, F.concat(F.date_format(day, "dd MMM yyyy"), F.lit(" 08:30:00 GMT")))
        .otherwise(F.lit(""))
    )
    ticker = F.get(F.array(*map(F.lit, TICKERS)), (d % 7).cast("int"))
    market = F.create_map(*(F.lit(x) for pair in (("en", "US"), ("de", "KR"), ("fr", "JP"), ("es", "CN")) for x in pair))
    known = _pick(TICKERS[:4], d % 4)
    score = F.round(((d * 37) % 201 - 100) / 100.0, 4)
    return table(spark, sf_dir, "documents").select(
        d.alias("seq"),
        "source",
        F.concat(F.lit("cn_"), "source").alias("source_cn"),
        _pick(("rss", "api", "social"), kind).alias("type"),
        F.substring("text", 1, 200).alias("title"),
        F.concat("text", F.coalesce(F.concat(F.lit(" "), ticker), F.lit(""))).alias("text"),
        F.when(d % 50 == 0, "").otherwise(F.concat(F.lit("https://ex.org/"), (d % 600).cast("string"))).alias("url"),
        published.alias("published"),
        F.lit("2024-01-31T00:00:00+00:00").alias("collected_at"),
        F.col("lang").alias("language"),
        market[F.col("lang")].alias("market"),
        ((d * 7919) % 200000).alias("followers"),
        ((d * 31) % 500).alias("retweets"),
        ((d * 17) % 900).alias("likes"),
        ((d * 13) % 300).alias("comments"),
        ((d * 11) % 400).alias("score"),
        F.when(kind == 2, F.concat(F.lit("and here from "), "source")).alias("comments_text"),
        F.when(kind == 1, F.create_map(F.ltrim(known, F.lit("$")), F.struct(score.alias("score"), F.when(score > 0, "up").otherwise("down").alias("label")))).alias("ticker_sentiments"),
    )


def responses(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """market, symbol, collected_at and the JSON body of provider responses, ten items each."""
    d = F.col("doc_id")
    market = F.create_map(*(F.lit(x) for pair in (("en", "US"), ("de", "KR"), ("fr", "JP"), ("es", "CN")) for x in pair))
    title, about, url = F.substring("text", 1, 80), F.expr("substring(text, 81)"), F.concat(F.lit("https://ex.org/"), d.cast("string"))
    day = F.lpad((d % 28 + 1).cast("string"), 2, "0")
    score = F.format_string("%.2f", ((d * 37) % 201 - 100) / 100.0)
    label = F.when((d * 37) % 201 > 100, "up").otherwise("down")
    told = lambda t, x: F.struct(F.lit(t).alias("ticker"), x.alias("ticker_sentiment_score"), label.alias("ticker_sentiment_label"))
    if kind == "scored":
        item = F.struct(
            title.alias("title"),
            about.alias("summary"),
            url.alias("url"),
            F.concat(F.lit("202401"), day, F.lit("T083015")).alias("time_published"),
            score.alias("overall_sentiment_score"),
            label.alias("overall_sentiment_label"),
            F.array(told("AAPL", F.lit("0.9")), told("V", F.lit("n/a")), told("AAPL", score)).alias("ticker_sentiment"),
        )
        body = F.to_json(F.struct(F.collect_list(item).alias("feed")))
    elif kind == "entity":
        item = F.struct(
            title.alias("title"),
            about.alias("description"),
            url.alias("url"),
            F.concat(F.lit("2024-01-"), day, F.lit("T08:00:00Z")).alias("published_at"),
            F.when(d % 5 != 0, score).alias("sentiment"),
            score.alias("sentiment_score"),
            F.array(F.struct(F.lit("V").alias("symbol"), F.lit("equity").alias("type"))).alias("entities"),
        )
        body = F.to_json(F.struct(F.collect_list(item).alias("data")))
    else:
        item = F.struct(title.alias("title"), about.alias("description"), url.alias("url"), F.concat(F.lit("2024-01-"), day).alias("publishedAt"), F.struct(F.col("source").alias("name")).alias("source"))
        body = F.to_json(F.struct(F.collect_list(item).alias("articles")))
    rows = table(spark, sf_dir, "documents").groupBy(F.floor(d / 40).alias("_page"), market[F.col("lang")].alias("market")).agg(body.alias("body"))
    return rows.select("market", F.format_string("%06d", F.col("_page") % 7 + 1).alias("symbol"), F.lit("2024-01-31T00:00:00+00:00").alias("collected_at"), "body")


def news_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a table of news: time, another cell and a headline with its link."""
    d = F.col("doc_id")
    market = F.create_map(*(F.lit(x) for pair in (("en", "US"), ("de", "KR"), ("fr", "JP"), ("es", "CN")) for x in pair))
    row = F.concat(
        F.lit("<tr><td> 08:30 </td><td>x</td><td><a class='k' href=\"https://ex.org/"), d.cast("string"), F.lit('"> <b>Item</b> '), d.cast("string"), F.lit(" the &amp; "), F.coalesce("source", F.lit("")), F.lit("</a></td></tr>")
    )
    rows = table(spark, sf_dir, "documents").groupBy(F.floor(d / 40).alias("page"), market[F.col("lang")].alias("market")).agg(F.sort_array(F.collect_list(F.struct(d, row.alias("row")))).alias("rows"))
    html = F.concat(F.lit('<p>head</p><table id="t" class="big news"><tr><td>no</td></tr>'), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("</table>"))
    return rows.select("market", F.lit("2024-01-31T00:00:00+00:00").alias("collected_at"), html.alias("html"))


def social_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of four networks with their engagement."""
    rows = articles(spark, sf_dir)
    network = _pick(("twitter", "weibo", "reddit", "telegram"), F.col("seq") % 4)
    return rows.select("seq", network.alias("network"), F.col("text").alias("content"), "url", "published", "market", "collected_at", "followers", "retweets", "likes", "comments")


def feed_sources(spark: SparkSession) -> DataFrame:
    """Feeds with their language."""
    rows = [("a", "en", True), ("b", "zh", True), ("c", "jp", True), ("d", "kr", True), ("e", "de", True), ("f", "en", False)]
    return spark.createDataFrame(rows, "source string, language string, enabled boolean")


def event_score():
    return clamp((F.col("value") - 35) / 120.7)


def daily_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, symbol, sentiment_score, news_count, sentiment_std from the events."""
    symbols = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    events = table(spark, sf_dir, "events").crossJoin(F.broadcast(symbols)).select(  # one row
        F.lpad((F.col("user_id") % F.col("n") + 1).cast("string"), 6, "0").alias("symbol"),
        F.date_add(F.lit("1994-01-03").cast("date"), ((F.col("event_id") % 150) * 7).cast("int")).alias("date"),
        event_score().alias("score"),
    )
    return events.groupBy("date", "symbol").agg(
        F.round(F.avg("score"), 12).alias("sentiment_score"), F.count(F.lit(1)).alias("news_count"), F.round(F.stddev_pop("score"), 12).alias("sentiment_std")
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polled sentiment of each market, one row a poll."""
    return as_snapshots(table(spark, sf_dir, "events"))


def as_snapshots(events: DataFrame) -> DataFrame:
    """Events, a table or a stream of them, as polls; one that failed has its error and score 0."""
    market = F.create_map(*(F.lit(x) for pair in (("click", "CN"), ("view", "US"), ("signup", "KR"), ("purchase", "JP"), ("error", "CN")) for x in pair))
    failed = F.col("event_type") == "error"
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("seq"),
        ts.alias("timestamp"),
        market[F.col("event_type")].alias("market"),
        F.when(failed, 0.0).otherwise(event_score()).alias("sentiment_score"),
        (F.col("user_id") % 20).alias("article_count"),
        F.create_map(F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")), F.col("user_id") % 20).alias("source_counts"),
        F.lit(0.0).alias("collection_time_s"),
        F.when(failed, F.col("event_type")).alias("error"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a video with its comments: the title and up to 20 later turns."""
    turns = table(spark, sf_dir, "conversations").where("turn IS NOT NULL")
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return grouped.select("conv_id", F.get("turns", F.lit(0))["text"].alias("title"), F.slice("turns", 2, 20).alias("later"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the trading journal.  Days differ in how many of the four slots they have."""
    slots = F.array(*map(F.lit, ("0700", "0925", "1330", "0955")))
    e = F.col("event_id")
    slot = e % (F.day("ts") % 4 + 1) + 1
    rows = table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("entry_date"), F.element_at(slots, slot.cast("int")).alias("slot"), F.col("ts").cast("timestamp").alias("timestamp"), e.alias("seq"), (F.col("user_id") % 100).alias("pick")
    )
    return rows.select("entry_date", "slot", "timestamp", "seq", F.to_json(F.struct("slot", "pick")).alias("payload"), F.format_string("%06d", F.col("pick") + 1).alias("top_symbol"))
