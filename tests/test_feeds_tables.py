"""Provider responses on literals, and tables and files written and read again."""

import json

import pytest
from pyspark.sql import functions as F

from quantloom.operators import selection, timeline
from quantloom.plans import queries
from quantloom.sources import feeds, tables, views

AT = "2024-01-31T00:00:00+00:00"


def raw(spark, *bodies, market="US"):
    return spark.createDataFrame([(market, "AAPL", AT, b if isinstance(b, str) or b is None else json.dumps(b)) for b in bodies], "market string, symbol string, collected_at string, body string")


def test_scored_response(spark):
    told = [{"ticker": "V", "ticker_sentiment_score": "0.5", "ticker_sentiment_label": "x"}, {"ticker": "V", "ticker_sentiment_score": 0.7}, {"ticker": "MA"}]
    body = {"feed": [{"title": "A", "summary": "b" * 600, "url": "u", "time_published": "20240131T083000", "overall_sentiment_score": "0.25", "ticker_sentiment": told}, {}]}
    full, empty = feeds.scored_articles(raw(spark, body, "not json", "{}", None)).orderBy(F.desc("title")).collect()
    assert list(full.asDict()) == list(feeds.ARTICLE)
    assert (full.text, len(full.summary), full.published, full.sentiment, full.sentiment_label) == ("A " + "b" * 600, 500, "2024-01-31T08:30:00", 0.25, "Neutral")
    assert {k: (v.score, v.label) for k, v in full.ticker_sentiments.items()} == {"V": (0.7, "Neutral"), "MA": (0.0, "Neutral")}
    assert (empty.title, empty.text, empty.sentiment, empty.ticker_sentiments) == ("", " ", 0.0, {})


def test_news_and_entity_responses(spark):
    news = {"articles": [{"title": " Rally \n", "description": None, "source": {"name": "n"}}, {"title": " ", "description": ""}]}
    (row,) = feeds.news_articles(raw(spark, news), ["RALLY", "other"]).collect()
    assert (row.title, row.text, row.sentiment, row.relevance, row.language, row.source_name) == ("Rally", "Rally", pytest.approx(0.15), 1.0, "en", "n")
    assert feeds.news_articles(raw(spark, news, market="CN")).first().language == "zh"
    named = {"data": [{"title": "t", "description": "d", "sentiment": None, "entities": [{"symbol": "V", "type": "equity"}]}, {"title": "s", "sentiment": "-0.5"}]}
    found = feeds.entity_articles(raw(spark, named)).orderBy("title").collect()
    assert [(r.text, r.sentiment) for r in found] == [("s", -0.5), ("t d", 0.0)] and found[1].entities[0].symbol == "V"
    both = feeds.entity_articles(raw(spark, named)).unionByName(feeds.news_articles(raw(spark, news)))
    assert [r.sentiment for r in feeds.strongest(both, 2).collect()] == [-0.5, pytest.approx(0.15)]


def test_daily_scores(spark):
    body = {"feed": [{"time_published": "20240131T08", "overall_sentiment_score": s} for s in ("0.5", "x")] + [{"time_published": ""}]}
    assert [(str(r.date), r.symbol, r.sentiment_score, r.news_count) for r in feeds.scored_daily(raw(spark, body)).collect()] == [("2024-01-31", "AAPL", 0.25, 2)]
    body = {"data": [{"published_at": "2024-01-31T08:00:00Z", "sentiment_score": 0.5}, {"published_at": "soon"}]}
    assert [(str(r.date), r.sentiment_score, r.news_count) for r in feeds.entity_daily(raw(spark, body)).collect()] == [("2024-01-31", 0.5, 1)]


def test_news_table(spark):
    row = "<tr><td> 08:30 </td><td>x</td><td><a class='k' href=\"/a?b\"> Stocks <b>rally</b></a></td></tr>"
    html = f'<table class="other"><tr><td>1</td><td>2</td><td>no</td></tr></table><table id="t" class="big news">{row}<tr><td>1</td><td>2</td></tr><tr><td>1</td><td>2</td><td> </td></tr></table>'
    pages = spark.createDataFrame([("US", AT, html), ("US", AT, None), ("US", AT, f'<table class="news">{row * 60}</table>')], "market string, collected_at string, html string")
    found = feeds.table_articles(pages).collect()
    assert len(found) == 51
    assert (found[0].published, found[0].title, found[0].url, found[0].sentiment) == ("08:30", "Stocksrally", "/a?b", pytest.approx(0.15))


def test_posts(spark):
    posts = spark.createDataFrame([("a" * 3000, None, "2024-01-01", "US", AT, 5), ("", "u", "", "US", AT, 1), (None, "u", "", "US", AT, 1)], "content string, url string, published string, market string, collected_at string, likes int")
    (row,) = feeds.social_articles(posts, "board", "Board", market="CN").collect()
    assert (len(row.title), len(row.text), row.url, row.likes, row.market, row.language, row.followers) == (200, 2000, "", 5, "CN", "zh", None)


def test_bars_in_other_shapes(spark):
    wide = spark.createDataFrame([("2024-01-02", 1.0, 2.0, None), ("2024-01-03", None, 3.0, None)], "date string, AAPL_Close double, V_Close double, V_Open double")
    found = feeds.long_bars(wide, ["AAPL", "V"]).orderBy("symbol", "date").collect()
    assert [(r.symbol, str(r.date), r.open, r.close) for r in found] == [("AAPL", "2024-01-02", None, 1.0), ("V", "2024-01-02", None, 2.0), ("V", "2024-01-03", None, 3.0)]
    named = feeds.named_bars(spark.createDataFrame([("2024-01-02", 1.0, 5.0)], "`日期` string, `开盘` double, `涨跌幅` double")).first()
    assert (str(named.date), named.open, named.pct_chg) == ("2024-01-02", 1.0, 0.05)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.current(spark, path) is None and tables.versions(spark, path) == [] and tables.prune(spark, path) == []
    for n in (1, 2, 3):
        tables.publish(spark.range(n).withColumn("market", F.lit("US")), path, partition_by=["market"])
    assert tables.current(spark, path).count() == 3
    assert tables.publish(spark.range(4).withColumn("market", F.lit("US")), path, version=2) == 2  # again, with the same result
    assert tables.prune(spark, path, keep=1) == [0, 1] and [v for v, n in tables.versions(spark, path) if n > 0] == [2]
    assert tables.current(spark, path).count() == 4
    tables.clear(spark, path)
    assert tables.current(spark, path) is None


def test_only_stale_symbols_are_fetched(spark, tmp_path):
    schema, asked = "market string, symbol string, date date, close double", []

    def fetch(symbols):
        asked.append(sorted(r.symbol for r in symbols.collect()))
        return symbols.where("symbol != 'C'").selectExpr("'US' AS market", "symbol", "DATE'2024-01-30' AS date", "2.0D AS close")

    path = str(tmp_path / "bars")
    tables.publish(spark.sql("SELECT 'US' AS market, s AS symbol, DATE'2024-01-29' - d AS date, 1.0D AS close FROM VALUES ('A', 0), ('A', 9), ('B', 9), ('C', 9), ('D', 0) AS t(s, d)"), path)
    wanted = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    rows = lambda df: sorted((r.symbol, str(r.date), r.close) for r in df.collect())
    first = rows(tables.refresh_bars(wanted, path, fetch, "2024-01-31"))
    assert asked == [["B", "C"]]
    assert first == [("A", "2024-01-20", 1.0), ("A", "2024-01-29", 1.0), ("B", "2024-01-30", 2.0), ("C", "2024-01-20", 1.0)]
    assert {r.symbol for r in tables.current(spark, path).collect()} == set("ABCD")
    tables.refresh_bars(wanted.where("symbol != 'C'"), path, fetch, "2024-01-31")
    assert len(asked) == 1
    new = tables.refresh_bars(wanted, str(tmp_path / "new"), fetch, "2024-01-31")
    assert new.schema["close"].dataType == spark.createDataFrame([], schema).schema["close"].dataType and asked[1] == ["A", "B", "C"]


def test_files_for_others(spark, sf_dir, tmp_path):
    made = queries.predictions(spark, sf_dir).cache()
    picks = selection.diversified(selection.latest(made))
    tables.write_predictions(picks, str(tmp_path / "p"))
    back = tables.read_predictions(spark, str(tmp_path / "p"), "market string, rank long, symbol string, pred_ret double")
    rows = lambda df: sorted((r.market, r["rank"], r.symbol, round(r.pred_ret, 4)) for r in df.collect())
    assert [x[:3] for x in rows(back)] == [x[:3] for x in rows(picks)]
    assert [x[3] for x in rows(back)] == pytest.approx([x[3] for x in rows(picks)], abs=1.1e-4)
    tables.write_backtest(made, str(tmp_path / "b"))
    assert spark.read.option("header", True).csv(str(tmp_path / "b/summary")).count() == selection.backtest(made).count()
    assert spark.read.option("header", True).csv(str(tmp_path / "b/curves")).where("top_k = 10").count() == selection.topk_daily(made).count()
    snaps = views.snapshots(spark, sf_dir)
    tables.write_curve_snapshot(snaps, str(tmp_path / "c"), views.AS_OF)
    stats = spark.read.json(str(tmp_path / "c")).collect()
    assert {r.market for r in stats} == {r.market for r in timeline.recent(snaps, views.AS_OF, 24).select("market").distinct().collect()}
    assert all(r.first_ts <= r.last_ts and "T" in r.last_ts for r in stats)
    tables.write_decision(timeline.slot_0955(snaps, views.AS_OF), str(tmp_path / "d"), views.AS_OF)
    assert spark.read.json(str(tmp_path / "d")).first().decision in ("SELL", "HOLD_CAUTION")


def test_article_cache_and_journal(spark, sf_dir, tmp_path):
    path = str(tmp_path / "news")
    rows = views.articles(spark, sf_dir).select("seq", "market", "text").where("market IS NOT NULL")
    tables.write_articles(rows, rows.groupBy("market").count(), path, "2024-01-31T00:00:00Z")
    (tmp_path / "news/articles/market=US/broken.json").write_text('{"seq": 1, broken\n')
    fresh = lambda at: tables.read_articles(spark, path, "seq long, text string", at).count()
    assert fresh("2024-01-31 05:59:59") == rows.count() and fresh("2024-01-31 06:00:00") == 0
    entries = views.journal(spark, sf_dir)
    for part in (0, 1):
        tables.append_journal(entries.where(F.col("seq") % 2 == part), str(tmp_path / "j"))
    assert tables.read_journal(spark, str(tmp_path / "j")).count() == entries.count()


def test_communities_share_a_limit_and_empty_posts_take_a_place(spark):
    schema = "network string, market string, community string, content string, url string, published string, collected_at string, likes long"
    posts = [("reddit", m, "stocks", "" if i == 3 else f"post {i}", f"u{i}", f"2024-01-0{i}", "now", None) for i, m in enumerate(("CN", "US", "US", "KR"))]
    posts += [("reddit", "US", "pics", "no", "p", "2024-01-09", "now", 1), ("telegram", None, "financialnews", "a", "t0", "2024-01-01", "now", 1), ("telegram", "US", "financialnews", "b", "t1", "2024-01-01", "now", 1)]
    df = spark.createDataFrame(posts, schema)
    found = {(r.url, r.source_cn, r.market) for r in feeds.community_articles(df, 8).collect()}
    assert found == {("u2", "r/stocks", "US"), ("t0", "Telegram/financialnews", None)}  # two of a subreddit, one of them empty
    oldest = {r.url for r in feeds.community_articles(df, 8, ["published"]).collect()}
    assert oldest == {"u0", "u1", "t0"}
    assert feeds.community_articles(df.where("false"), 8).collect() == []
