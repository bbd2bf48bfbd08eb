"""DuckDB SQL of the queries in ``flow``: what has been written and read again must be what was meant."""

from __future__ import annotations

from quantloom.plans import oracle as base
from quantloom.plans.oracle import ANALYZED, ART, BARS, DAILY, FEAT, FEED, LABELLED, MACRO, NEG, POS, RULED, RULES, SNAP, TICKED, hits, r, stages

_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
_STAMP = "%Y-%m-%d %H:%M:%S.%f"


def _quick(text: str) -> str:
    return f"greatest(-1.0, least(1.0, ({hits(text, POS)} - {hits(text, NEG)}) * 0.15))"


def _day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d') AS {column}"


_PRESETS = {
    "CN": "600519.SS 000858.SZ 300750.SZ 601318.SS 000333.SZ 600036.SS 002415.SZ 688981.SS".split(),
    "US": "AAPL MSFT GOOGL AMZN NVDA TSLA META AVGO JPM V".split(),
    "KR": "005930.KS 000660.KS 035420.KQ 091990.KQ".split(),
}


def _preset(market: str, known: str) -> str:
    return f"SELECT '{market}' AS market, unnest({_PRESETS[market]}) AS code, {known} AS known"


_ENTITY = r"""entity AS (SELECT n.*, CASE WHEN d % 5 != 0 THEN score ELSE 0 END AS s FROM news n WHERE text != '')"""
_TABLE = """listed AS (SELECT 'https://ex.org/' || d AS url, market, trim('Item' || d || ' the & ' || coalesce(source, '')) AS title FROM item)"""
_SOCIAL = """network AS (SELECT *, (['twitter', 'weibo', 'reddit', 'telegram'])[(seq % 4 + 1)::INT] AS net FROM art WHERE text != ''),
posts AS (SELECT net AS source, (['Twitter', 'Weibo', 'Reddit', 'Telegram'])[(seq % 4 + 1)::INT] AS source_cn, CASE WHEN net = 'reddit' THEN 'US' ELSE market END AS market, coalesce(url, '') AS url, text, likes
  FROM network WHERE net != 'weibo' OR market IN ('CN', 'JP'))"""
_EVENTS = f"{SNAP}, mark AS (SELECT max(timestamp) - INTERVAL 72 HOUR AS ended FROM snap)"


def oracle_sql() -> dict[str, str]:
    panel, timeline, feeds = base._panel(), base._timeline(), base._feeds()
    ticked, ruled = f"{ART}, {ANALYZED}, {TICKED}", stages(RULED, RULES)
    tests = [f"({base._OK['name']} OR NOT st_filter)", "n_bars >= 60", *(base._OK[k] for k in ("limit", "up", "liquid", "amount"))]
    names = ("name", "history", "price_limit", "limit_up", "liquidity", "amount")
    kept = lambda n: "count(*)" if n == 0 else f"count(*) FILTER ({' AND '.join(tests[:n])})"
    audit = " UNION ALL ".join(f"SELECT market, {i}::INT AS step, '{name}' AS rule, {kept(i - 1)} AS before, {kept(i)} AS after FROM w GROUP BY market" for i, name in enumerate(names, 1))
    ics = panel["ic_topn"].split(" ORDER BY abs(ic)")[0]
    return {
        "bar_buckets": f"WITH {BARS} SELECT market, count(*) AS n, count(DISTINCT symbol) AS symbols, {r('sum(close)')} AS close, true AS files_kept FROM bars GROUP BY market",
        "bar_cache": f"WITH {BARS} SELECT market, symbol, {_day('date')}, {r('close')} AS close FROM bars",
        "sink_predictions": f"SELECT market, rank, symbol, round(pred_ret, 4) + 0 AS pred_ret FROM ({panel['diversified_topk']})",
        "sink_backtest": panel["backtest_topk"],
        "sink_curve_snapshot": f"SELECT market, last, low, high, n, strftime(first_ts, '%Y-%m-%dT%H:%M:%SZ') AS first_ts FROM ({timeline['curve_snapshot']})",
        "sink_articles": f"WITH {ART} SELECT seq, market, url FROM art WHERE market IS NOT NULL",
        "sink_journal": f"SELECT strftime(ts::DATE, '%Y-%m-%d') AS entry_date, (['0700', '0925', '1330', '0955'])[(event_id % (day(ts) % 4 + 1) + 1)::INT] AS slot, count(*) AS n, max(event_id) AS last_seq FROM events GROUP BY 1, 2",
        "sink_decision": f"SELECT '2024-01-31 00:00:00' AS timestamp, * FROM ({timeline['slot_0955']})",
        "sink_ic": ics,
        "timeline_versions": f"WITH {SNAP} SELECT seq, strftime(timestamp, '{_STAMP}') AS timestamp, market, {r('hourly.sentiment_score')} AS sentiment_score, article_count FROM hourly WHERE market IS NOT NULL AND hourly.timestamp >= (SELECT max(timestamp) FROM hourly WHERE market IS NOT NULL) - INTERVAL 72 HOUR",
        "table_admin": "SELECT * FROM (VALUES (1::BIGINT, true, false), (2::BIGINT, true, true)) t(version, filled, current)",
        "feed_entity": f"WITH {FEED}, {_ENTITY} SELECT url, market, title, substr(about, 1, 500) AS summary, substr(text, 1, 2000) AS text, '2024-01-' || day || 'T08:00:00Z' AS published, {r('s')} AS sentiment, 'V' AS entity FROM entity",
        "feed_entity_daily": f"SELECT * REPLACE ({_day('date')}) FROM ({feeds['feed_daily']})",
        "feed_bars": f"WITH {BARS} SELECT symbol, {_day('date')}, {r('open')} AS open, {r('close')} AS close, {r('volume')} AS volume, {r('close / open - 1')} AS pct_chg FROM bars",
        "feed_long_bars": f"WITH {BARS} SELECT {_day('date')}, symbol, NULL::DOUBLE AS open, {r('close')} AS close, {r('volume')} AS volume FROM bars WHERE symbol IN ('000001', '000002', '000003')",
        "sentiment_records": f"WITH {DAILY} SELECT {_day('date')}, symbol, CASE WHEN symbol::INT % 7 = 0 THEN 0 ELSE {r('sentiment_score')} END AS sentiment_score, news_count FROM daily WHERE symbol::INT % 11 != 0",
        "feed_table": f"WITH {FEED}, {_TABLE} SELECT url, market, title, '08:30' AS published, {r(_quick('title'))} AS sentiment FROM listed",
        "feed_social": f"WITH {ART}, {_SOCIAL} SELECT source, source_cn, market, CASE WHEN market = 'CN' THEN 'zh' ELSE 'en' END AS language, url, substr(text, 1, 200) AS title, least(length(text), 2000)::INT AS length, likes FROM posts",
        "social_mix": f"""WITH {ART}, {_SOCIAL}, q AS (SELECT source, likes, url, list_position(['twitter', 'weibo', 'reddit', 'telegram'], source) AS p, row_number() OVER (PARTITION BY source ORDER BY likes DESC, url) AS k FROM posts WHERE url != ''),
          c AS (SELECT * FROM q WHERE k <= CASE WHEN source = 'twitter' THEN 20 ELSE 10 END QUALIFY row_number() OVER (ORDER BY p, k) <= 40) SELECT source, count(*) AS n, sum(likes)::BIGINT AS likes FROM c GROUP BY source""",
        "sink_curves": panel["cum_returns"].split(" SELECT date, ")[0] + f" SELECT top_k, {_day('date')}, {r('ret')} AS ret, {r('product(1 + ret) OVER (PARTITION BY top_k ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS cum FROM td",
        "table_contents": f"WITH {SNAP} SELECT CASE market WHEN 'US' THEN 1 WHEN 'KR' THEN 2 ELSE 3 END::BIGINT AS version, market, count(*) AS n, max(seq) AS last_seq FROM snap WHERE market IN ('US', 'KR', 'JP') GROUP BY market",
        "social_communities": f"""WITH {ART}, p AS (SELECT *, seq // 4 AS turn, (['twitter', 'weibo', 'reddit', 'telegram'])[(seq % 4 + 1)::INT] AS net FROM art WHERE coalesce(url, '') != ''),
          c AS (SELECT 'reddit' AS source, 'US' AS market, (['wallstreetbets', 'stocks', 'investing', 'stockmarket', NULL])[(turn % 5 + 1)::INT] AS community, 4 AS lists, 'r/' AS before, seq, likes, url, text FROM p WHERE net = 'reddit'
            UNION ALL SELECT 'telegram', market, (['A股情报', '财经早报', '股票交流', 'stockmarketnews', 'wallstreetbets', 'cryptomarket', 'financialnews', NULL])[(turn % 8 + 1)::INT], CASE WHEN market IN ('CN', 'US') THEN 3 ELSE 1 END, 'Telegram/', seq, likes, url, text FROM p WHERE net = 'telegram'),
          k AS (SELECT *, row_number() OVER (PARTITION BY source, market, community ORDER BY seq) AS nth FROM c WHERE source = 'reddit' AND community IS NOT NULL
            OR source = 'telegram' AND list_contains(CASE market WHEN 'CN' THEN ['A股情报', '财经早报', '股票交流'] WHEN 'US' THEN ['stockmarketnews', 'wallstreetbets', 'cryptomarket'] ELSE ['financialnews'] END, community))
          SELECT source, before || community AS source_cn, market, count(*) AS n, sum(likes)::BIGINT AS likes, max(url) AS last_url FROM k WHERE nth <= greatest(1, 20 // lists) AND text != '' GROUP BY ALL""",
        "rss_sources": "SELECT market, unnest(string_split(found, '')) AS source FROM (VALUES ('CN', 'b'), ('US', 'acd'), ('KR', 'acd'), ('JP', 'abcde')) t(market, found)",
        "news_fan_out": f"""WITH {FEED}, {_ENTITY}, {_TABLE}, every AS (SELECT url, title, abs(score) AS s FROM item UNION ALL SELECT url, title, abs(s) FROM entity UNION ALL SELECT url, title, abs({_quick('title')}) FROM listed)
          (SELECT url, {r('s')} AS strength, NULL::VARCHAR AS error FROM every ORDER BY s DESC, url, title LIMIT 200) UNION ALL SELECT NULL, NULL, 'TimeoutError: no answer'""",
        "universe_select": f"(SELECT 'CN' AS market, lpad(s_suppkey::VARCHAR, 6, '0') AS code, true AS known FROM supplier ORDER BY code LIMIT 500) UNION ALL {_preset('CN', 'false')} UNION ALL {_preset('US', 'true')} UNION ALL {_preset('KR', 'true')}",
        "market_data": f"""WITH {BARS}, {DAILY}, {MACRO}, u AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol FROM supplier ORDER BY symbol LIMIT 500),
          p AS (SELECT 'ohlcv' AS part, date FROM bars WHERE market = 'CN' AND date >= DATE '1995-01-01' AND symbol IN (SELECT symbol FROM u) UNION ALL SELECT 'sentiment', date FROM daily WHERE symbol IN (SELECT symbol FROM u) UNION ALL SELECT 'macro', date FROM macro)
          SELECT part, count(*) AS n, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last FROM p GROUP BY part""",
        "clean_columns": f"WITH {MACRO} SELECT {_day('date')}, {r('medium')} AS medium, {r('unspecified')} AS unspecified, {r('low')} AS low FROM macro",
        "filter_audit": f"WITH {ruled}, w AS (SELECT * FROM ruled r LEFT JOIN rules USING (market) WHERE date = (SELECT max(date) FROM ruled m WHERE m.market = r.market)) {audit}",
        "ticker_whitelist": f"WITH {ticked} SELECT ticker, {r('sum(sentiment * weight) / sum(weight)')} AS sentiment_score, count(*) AS news_count FROM tk WHERE ticker IN ('AAPL', 'V') GROUP BY ticker",
        "news_snapshot": f"""WITH {ticked}, m AS (SELECT market, sum(sentiment * weight) / sum(weight) AS s, count(*) AS article_count, count(DISTINCT source_cn)::INT AS sources, count(source_cn) AS counted FROM an GROUP BY market),
          dy AS (SELECT market, date, ticker, avg(sentiment) AS s FROM tk GROUP BY market, date, ticker), da AS (SELECT market, avg(s) AS a FROM dy GROUP BY market),
          tt AS (SELECT market, ticker, round(avg(sentiment), 9) AS sc FROM tk GROUP BY market, ticker QUALIFY row_number() OVER (PARTITION BY market ORDER BY abs(sc) DESC, ticker) <= 10),
          tl AS (SELECT market, string_agg(ticker, ',' ORDER BY abs(sc) DESC, ticker) AS tickers FROM tt GROUP BY market)
          SELECT market, '2024-01-31 00:00:00.000000' AS timestamp, round(coalesce(a, s), 4) + 0 AS sentiment_score, article_count, sources, counted, coalesce(tickers, '') AS tickers, false AS is_trading_hour, NULL::VARCHAR AS error
          FROM m LEFT JOIN da USING (market) LEFT JOIN tl USING (market) WHERE market IS NOT NULL""",
        "stream_hours": f"WITH {_EVENTS} SELECT strftime(date_trunc('hour', timestamp), '{_STAMP}') AS hour, market, seq, {r('sentiment_score')} AS sentiment_score, article_count FROM hourly, mark WHERE date_trunc('hour', timestamp) + INTERVAL 1 HOUR <= ended",
        "stream_means": f"""WITH {_EVENTS}, w AS (SELECT market, sentiment_score, time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '1970-01-01') - to_hours(6 * k) + INTERVAL 24 HOUR AS until FROM snap, (SELECT unnest([0, 1, 2, 3]) AS k))
          SELECT strftime(until, '{_STAMP}') AS until, market, {r('avg(sentiment_score)')} AS mean_score, count(*) AS n FROM w, mark WHERE until <= ended GROUP BY until, market""",
        "stream_sessions": f"""WITH {_EVENTS}, f AS (SELECT market, timestamp, CASE WHEN timestamp - lag(timestamp) OVER o <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM snap WINDOW o AS (PARTITION BY market ORDER BY timestamp, seq)),
          g AS (SELECT market, timestamp, sum(fresh) OVER (PARTITION BY market ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS id FROM f), s AS (SELECT market, min(timestamp) AS a, max(timestamp) + INTERVAL 30 MINUTE AS b, count(*) AS n FROM g GROUP BY market, id)
          SELECT strftime(a, '{_STAMP}') AS start, strftime(b, '{_STAMP}') AS "end", market, n FROM s, mark WHERE b <= ended""",
        "stream_urls": "SELECT CASE WHEN event_id % 50 = 0 THEN '' ELSE 'https://ex.org/' || (event_id % 600) END AS url, CASE WHEN url = '' THEN count(*) ELSE 1 END AS n FROM events GROUP BY 1",
        "news_fan_out_at_run_time": f"""WITH {FEED}, {_ENTITY}, every AS (SELECT url, title, abs(score) AS s FROM item UNION ALL SELECT url, title, abs(s) FROM entity)
          (SELECT url, {r('s')} AS strength, NULL AS failed FROM every ORDER BY s DESC, url, title LIMIT 200) UNION ALL SELECT NULL, NULL, 'newsapi' FROM (SELECT 1 FROM documents LIMIT 1)""",
        "snapshot_failures": f"""WITH {ART} SELECT market, count(*) AS article_count, NULL AS error FROM art WHERE market != 'KR' GROUP BY market
          UNION ALL SELECT 'KR', 0, 'TimeoutError: lost ' || count(*) FROM art WHERE market = 'KR' HAVING count(*) > 0""",
        "stream_settled_gaps": f"""WITH {SNAP}, mark AS (SELECT max(timestamp) - INTERVAL 24 HOUR AS ended FROM snap), g AS (SELECT market, lag(timestamp) OVER (PARTITION BY market ORDER BY timestamp, seq) AS a, timestamp AS b FROM snap)
          SELECT market, strftime(a, '{_STAMP}') AS gap_start, strftime(b, '{_STAMP}') AS gap_end, {r('epoch_us(b - a) / 3.6e9')} AS gap_hours FROM g, mark WHERE epoch_us(b - a) / 3.6e9 > 0.75 AND b <= ended""",
        "stream_gaps": f"""WITH {SNAP}, g AS (SELECT market, lag(timestamp) OVER (PARTITION BY market ORDER BY timestamp, seq) AS a, timestamp AS b FROM snap)
          SELECT market, strftime(a, '{_STAMP}') AS gap_start, strftime(b, '{_STAMP}') AS gap_end, {r('epoch_us(b - a) / 3.6e9')} AS gap_hours FROM g WHERE epoch_us(b - a) / 3.6e9 > 0.75""",
    }
