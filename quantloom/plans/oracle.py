"""The same queries as DuckDB SQL, written from their definitions and not from the Spark code."""

from __future__ import annotations

from quantloom.operators.text import US_SYMBOLS  # a fixed value

_BY = "l_shipdate, l_orderkey, l_linenumber, l_partkey, p"
BARS = f"""
px AS (SELECT l_suppkey, date_trunc('week', l_shipdate)::DATE AS date, l_extendedprice / l_quantity AS p, l_quantity AS q,
              l_extendedprice AS e, l_discount AS d, l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 0),
wk AS (SELECT l_suppkey, date, first(p ORDER BY {_BY}) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY {_BY}) AS close,
              sum(q) AS volume, round(sum(e), 2) AS amount, round(sum(d), 2) AS turnover FROM px GROUP BY l_suppkey, date),
bars AS (SELECT (['CN', 'US', 'KR', 'JP', 'US'])[n_regionkey + 1] AS market, lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, s_name AS name,
                n_name AS industry, date, open, high, low, close, volume, amount, turnover
         FROM wk JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
_SIZES = (3, 5, 10, 14, 20, 30, 60)
_SERIES = "PARTITION BY symbol ORDER BY date"
WIN = "WINDOW o AS (" + _SERIES + "), u AS (" + _SERIES + " ROWS UNBOUNDED PRECEDING), whole AS (PARTITION BY symbol), " + ", ".join(
    f"w{w} AS ({_SERIES} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in _SIZES
)
W5 = (5, 10, 20, 30, 60)


def fl(x: str, eps: str = "1e-12") -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({x}, {eps}) END)"


def rl(agg: str, x: str, w: int, least: int | None = None) -> str:
    least = max(1, w // 2) if least is None else least
    return f"(CASE WHEN count({x}) OVER w{w} >= {least} THEN {agg}({x}) OVER w{w} END)"


def z(x: str, other: str = "0") -> str:
    return f"coalesce({x}, {other})"


def r(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0"


def select(columns: dict[str, str], of: str, keys: str = "market, symbol, date", tail: str = "", ctes: str = "", doubles: bool = True) -> str:
    listed = ", ".join(f"{r(x) if doubles else x} AS {name}" for name, x in columns.items())
    first = f"{keys}, " if keys else ""
    return f"WITH {ctes or BARS} SELECT {first}{listed} FROM {of} {tail}"


def stages(*parts: str) -> str:
    return BARS + "".join(f",\n{p}" for p in parts)


def stage(name: str, columns: dict[str, str], of: str) -> str:
    return f"{name} AS (SELECT *, " + ", ".join(f"{x} AS {c}" for c, x in columns.items()) + f" FROM {of} {WIN})"


def ema(x: str, span: int) -> str:
    a = repr(2.0 / (span + 1))
    folded = f"list_reduce(list({x}) FILTER ({x} IS NOT NULL) OVER u, lambda p, q: p * (1 - {a}) + q * {a})"
    return f"(CASE WHEN count({x}) OVER u > 0 THEN {folded} END)"


def corr(x: str, y: str, w: int) -> str:
    x, y = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    spread = f"(stddev_pop({x}) OVER w{w} * stddev_pop({y}) OVER w{w})"
    return f"(CASE WHEN count({x}) OVER w{w} >= {w // 2} AND {spread} > 1e-12 THEN covar_pop({x}, {y}) OVER w{w} / {spread} END)"


def _factors() -> dict[str, str]:
    out: dict[str, str] = {}

    def put(name: str, columns: dict[str, str], of: str = "bars", ctes: str = "") -> None:
        out[f"f_{name}"] = select(columns, of, tail=WIN, ctes=ctes)

    put("ma", {f"ma_{w}": z(rl("avg", "close", w)) for w in (3, 5, 10, 20, 30, 60)} | {f"close_ma_{w}_ratio": z(f"close / {fl(rl('avg', 'close', w))} - 1") for w in (3, 5, 10, 20, 30, 60)})
    put("roc", {f"roc_{w}": z(f"(close - lag(close, {w}) OVER o) / {fl(f'lag(close, {w}) OVER o')}") for w in (5, 10, 20, 60)})
    ret = stage("s", {"ret": z("(close - lag(close) OVER o) / greatest(close, 1e-12)")}, "bars")
    put("volatility", {f"volatility_{w}": z(rl("stddev_pop", "ret", w)) for w in (5, 10, 20)}, "s", stages(ret))
    bb = stage("s", {"m": rl("avg", "close", 20), "sd": rl("stddev_pop", "close", 20)}, "bars")
    put("bollinger", {"bb_position": "CASE WHEN sd > 1e-12 THEN (close - m) / (2 * sd) ELSE 0 END", "bb_width": z(f"sd / {fl('m')}")}, "s", stages(bb))
    mac = stage("s", {"macd": f"{ema('close', 12)} - {ema('close', 26)}"}, "bars")
    sig = stage("t", {"macd_signal": ema("macd", 9)}, "s")
    put("macd", {"macd": "macd", "macd_signal": "macd_signal", "macd_hist": "macd - macd_signal"}, "t", stages(mac, sig))
    moves = stage("s", {"dl": "close - lag(close) OVER o"}, "bars")
    gains = "t AS (SELECT *, CASE WHEN dl IS NOT NULL THEN greatest(dl, 0.0) END AS gain, CASE WHEN dl IS NOT NULL THEN greatest(-dl, 0.0) END AS loss FROM s)"
    means = stage("v", {"eg": ema("gain", 14), "el": ema("loss", 14)}, "t")
    put("rsi", {"rsi_14": "coalesce(100 - 100 / (1 + eg / greatest(el, 1e-10)), 50)"}, "v", stages(moves, gains, means))
    tp = "s AS (SELECT *, (high + low + close) / 3 AS tp FROM bars)"
    put("cci", {"cci_20": "CASE WHEN mad > 1e-12 THEN (tp - sma) / (0.015 * mad) ELSE 0 END"}, "v", stages(tp, stage("t", {"sma": rl("avg", "tp", 20)}, "s"), stage("v", {"mad": rl("avg", "abs(tp - sma)", 20)}, "t")))
    pc = stage("s", {"pc": "coalesce(lag(close) OVER o, close)"}, "bars")
    tr = "t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM s)"
    put("atr", {"atr_14": z(rl("avg", "tr", 14)), "atr_pct": f"{z(rl('avg', 'tr', 14))} / greatest(close, 1e-12)"}, "t", stages(pc, tr))
    hl = stage("s", {"h": "max(high) OVER w20", "l": "min(low) OVER w20"}, "bars")
    put("price_pos", {"high_20": "h", "low_20": "l", "price_position_20": "CASE WHEN h - l > 1e-12 THEN (close - l) / (h - l) ELSE 0.5 END"}, "s", stages(hl))
    put(
        "volume",
        {f"volume_ma_{w}": z(rl("avg", "volume", w)) for w in (5, 20)}
        | {"volume_ratio_5": z(f"volume / {fl(rl('avg', 'volume', 5))}"), "volume_change_1": z(f"volume / {fl('lag(volume) OVER o')} - 1")},
    )
    gated = {c: f"(CASE WHEN sum({c}) OVER whole > 0 THEN {rl('avg', c, 20)} END)" for c in ("turnover", "amount")}
    put("amount", {f"{c}_ma_20": z(x) for c, x in gated.items()} | {f"{c}_ratio": z(f"{c} / {fl(x)}") for c, x in gated.items()})
    put("momentum", {f"momentum_{w}d": z(f"close / {fl(f'lag(close, {w}) OVER o')} - 1") for w in (1, 5, 10, 20)} | {"amplitude": "(high - low) / greatest(close, 1e-12)"})
    put(
        "kbar",
        {
            "KMID": "(close - open) / greatest(open, 1e-12)",
            "KLEN": "(high - low) / greatest(open, 1e-12)",
            "KMID2": "(close - open) / (high - low + 1e-12)",
            "KUP": "(high - greatest(open, close)) / greatest(open, 1e-12)",
            "KUP2": "(high - greatest(open, close)) / (high - low + 1e-12)",
            "KLOW": "(least(open, close) - low) / greatest(open, 1e-12)",
            "KLOW2": "(least(open, close) - low) / (high - low + 1e-12)",
            "KSFT": "(2 * close - high - low) / greatest(open, 1e-12)",
            "KSFT2": "(2 * close - high - low) / (high - low + 1e-12)",
        },
    )
    t = stage("s", {"t": "(row_number() OVER o)::DOUBLE"}, "bars")
    full = lambda w, x: f"CASE WHEN count(close) OVER w{w} = {w} AND var_pop(close) OVER w{w} * {w} > 1e-12 THEN {x} ELSE 0 END"
    slope, cut = (lambda w: f"regr_slope(close, t) OVER w{w}"), (lambda w: f"regr_intercept(close, t) OVER w{w}")
    put("beta", {f"BETA_{w}": full(w, f"{slope(w)} / close") for w in W5}, "s", stages(t))
    put("rsqr", {f"RSQR_{w}": full(w, f"regr_r2(close, t) OVER w{w}") for w in W5}, "s", stages(t))
    put("resi", {f"RESI_{w}": full(w, f"(close - ({cut(w)} + {slope(w)} * t)) / close") for w in W5}, "s", stages(t))
    qt = lambda w, q: f"coalesce(CASE WHEN count(close) OVER w{w} >= {w // 2} THEN quantile_cont(close, {q}) OVER w{w} END, first_value(close) OVER u) / close"
    put("quantile", {f"QTLU_{w}": qt(w, 0.8) for w in W5} | {f"QTLD_{w}": qt(w, 0.2) for w in W5})
    lists = stage("s", {f"l{w}": f"list(close) OVER w{w}" for w in W5}, "bars")
    put("rank", {f"RANK_{w}": f"CASE WHEN len(l{w}) >= {max(2, w // 2)} THEN len(list_filter(l{w}, lambda x: x <= close)) / len(l{w}) ELSE 0.5 END" for w in W5}, "s", stages(lists))
    put("rsv", {f"RSV_{w}": z(f"(close - {rl('min', 'low', w)}) / ({rl('max', 'high', w)} - {rl('min', 'low', w)} + 1e-12)") for w in W5})
    place = lambda x, agg, w: f"(CASE WHEN count({x}) OVER w{w} >= {w // 2} THEN (list_position(list({x}) OVER w{w}, {agg}({x}) OVER w{w}) - 1) / {w}.0 ELSE 0 END)"
    put("aroon", {f"IMAX_{w}": place("high", "max", w) for w in W5} | {f"IMIN_{w}": place("low", "min", w) for w in W5} | {f"IMXD_{w}": f"{place('high', 'max', w)} - {place('low', 'min', w)}" for w in W5})
    lv = "s AS (SELECT *, ln(volume + 1) AS lv FROM bars)"
    put("corr", {f"CORR_{w}": z(corr("close", "lv", w)) for w in W5}, "s", stages(lv))
    cr = stage("s", {"cr": f"close / {fl('lag(close) OVER o')}", "vr": f"ln(greatest(volume / {fl('lag(volume) OVER o')}, 1e-12))"}, "bars")
    vr = "t AS (SELECT * REPLACE (CASE WHEN cr IS NOT NULL THEN vr END AS vr) FROM s)"
    put("cord", {f"CORD_{w}": z(corr("cr", "vr", w)) for w in W5}, "t", stages(cr, vr))
    pv = stage("s", {"pc": "lag(close) OVER o", "pv": "lag(volume) OVER o"}, "bars")
    up, down = "(CASE WHEN close > pc THEN 1.0 ELSE 0.0 END)", "(CASE WHEN close < pc THEN 1.0 ELSE 0.0 END)"
    put("cnt", {f"CNTP_{w}": f"avg({up}) OVER w{w}" for w in W5} | {f"CNTN_{w}": f"avg({down}) OVER w{w}" for w in W5} | {f"CNTD_{w}": f"avg({up}) OVER w{w} - avg({down}) OVER w{w}" for w in W5}, "s", stages(pv))

    def moved(name: str, x: str, before: str, prefix: str) -> None:
        d = f"coalesce({x} - {before}, 0)"
        share = lambda part, w: f"CASE WHEN count({x}) OVER w{w} >= {w // 2} THEN sum({part}) OVER w{w} / (sum(abs({d})) OVER w{w} + 1e-12) ELSE 0 END"
        cols = {}
        for w in W5:
            cols |= {f"{prefix}P_{w}": share(f"greatest({d}, 0)", w), f"{prefix}N_{w}": share(f"greatest(-({d}), 0)", w), f"{prefix}D_{w}": f"({share(f'greatest({d}, 0)', w)}) - ({share(f'greatest(-({d}), 0)', w)})"}
        put(name, cols, "s", stages(pv))

    moved("sum", "close", "pc", "SUM")
    moved("vsum", "volume", "pv", "VSUM")
    put("vma", {f"VMA_{w}": z(f"volume / ({rl('avg', 'volume', w)} + 1e-12)") for w in W5} | {f"VSTD_{w}": z(f"{rl('stddev_pop', 'volume', w)} / ({rl('avg', 'volume', w)} + 1e-12)") for w in W5})
    wv = "t AS (SELECT *, coalesce(abs(close / greatest(pc, 1e-12) - 1) * volume, 0) * (CASE WHEN pc IS NULL THEN 0 ELSE 1 END) AS wv FROM s)"
    put("wvma", {f"WVMA_{w}": z(f"{rl('stddev_pop', 'wv', w)} / ({rl('avg', 'wv', w)} + 1e-12)") for w in W5}, "t", stages(pv, wv))
    return out


FEATURES = ("close_ma_5_ratio", "roc_5", "momentum_10d", "volume_ratio_5")
FEAT = stage(
    "feat",
    {
        "close_ma_5_ratio": r(z(f"close / {fl(rl('avg', 'close', 5))} - 1"), 12),
        "roc_5": r(z(f"(close - lag(close, 5) OVER o) / {fl('lag(close, 5) OVER o')}"), 12),
        "momentum_10d": r(z(f"close / {fl('lag(close, 10) OVER o')} - 1"), 12),
        "volume_ratio_5": r(z(f"volume / {fl(rl('avg', 'volume', 5))}"), 12),
    },
    "bars",
)
LABELLED = (
    stage("lab0", {"raw": "lead(close) OVER o / greatest(close, 1e-12) - 1"}, "feat")
    + ",\nlab AS (SELECT *, round(raw - median(raw) OVER (PARTITION BY market, date), 12) + 0 AS label FROM lab0)"
)
PRED = "pred AS (SELECT market, date, symbol, industry, close_ma_5_ratio AS pred_ret, label FROM lab WHERE label IS NOT NULL)"
LATEST = "latest AS (SELECT p.* FROM pred p JOIN (SELECT market, max(date) AS date FROM pred GROUP BY market) USING (market, date))"
MACRO = "macro AS (SELECT date_trunc('week', o_orderdate)::DATE AS date, " + ", ".join(
    f"round(sum(o_totalprice) FILTER (o_orderpriority = '{p}'), 2) AS {c}" for p, c in zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), ("urgent", "high", "medium", "unspecified", "low"), strict=True)
) + " FROM orders GROUP BY 1)"
_SCORE = "greatest(-1.0, least(1.0, (value - 35) / 120.7))"
DAILY = f"""daily AS (SELECT DATE '1994-01-03' + (event_id % 150 * 7)::INT AS date,
  lpad((user_id % (SELECT count(*) FROM supplier) + 1)::VARCHAR, 6, '0') AS symbol,
  round(avg({_SCORE}), 12) + 0 AS sentiment_score, count(*) AS news_count, round(stddev_pop({_SCORE}), 12) + 0 AS sentiment_std FROM events GROUP BY 1, 2)"""
SNAP = f"""snap AS (SELECT event_id AS seq, ts AS timestamp,
  CASE event_type WHEN 'view' THEN 'US' WHEN 'signup' THEN 'KR' WHEN 'purchase' THEN 'JP' WHEN 'click' THEN 'CN' WHEN 'error' THEN 'CN' END AS market,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE {_SCORE} END AS sentiment_score, user_id % 20 AS article_count FROM events),
hourly AS (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', timestamp), market ORDER BY timestamp DESC, seq DESC) = 1)"""
ART = r"""art0 AS (SELECT *, doc_id AS d, DATE '2024-01-01' + (doc_id % 30)::INT AS day, regexp_extract(source, '(\d+)$', 1)::INT % 3 AS kind FROM documents),
art AS (SELECT d AS seq, source, 'cn_' || source AS source_cn, (['rss', 'api', 'social'])[kind + 1] AS type, substr(text, 1, 200) AS title,
  text || CASE WHEN d % 7 < 6 THEN ' ' || (['$AAPL', '$MSFT', '$TSLA', '$NVDA', 'V', 'AMZN'])[(d % 7 + 1)::INT] ELSE '' END AS text,
  CASE WHEN d % 50 = 0 THEN '' ELSE 'https://ex.org/' || (d % 600) END AS url,
  CASE WHEN d % 6 = 4 THEN '' WHEN d % 6 = 5 THEN '' ELSE strftime(day, '%Y-%m-%d') END AS iso_day,
  CASE lang WHEN 'en' THEN 'US' WHEN 'de' THEN 'KR' WHEN 'fr' THEN 'JP' WHEN 'es' THEN 'CN' END AS market,
  (d * 7919) % 200000 AS followers, (d * 31) % 500 AS retweets, (d * 17) % 900 AS likes, (d * 13) % 300 AS comments, (d * 11) % 400 AS score,
  CASE WHEN kind = 2 THEN 'and here from ' || source END AS comments_text,
  CASE WHEN kind = 1 THEN (['AAPL', 'MSFT', 'TSLA', 'NVDA'])[(d % 4 + 1)::INT] END AS known,
  CASE WHEN kind = 1 THEN round(((d * 37) % 201 - 100) / 100.0, 4) + 0 END AS known_score,
  coalesce(nullif(CASE WHEN d % 6 < 4 THEN strftime(day, '%Y-%m-%d') ELSE '' END, ''), '2024-01-31') AS date FROM art0)"""


def hits(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(lower({text}), '{w.lower()}')::INT" for w in words) + ")"


POS, NEG = ("the", "and", "here"), ("ion", "rest")
_WEIGHT = """((CASE type WHEN 'api' THEN 1.2 WHEN 'social' THEN 0.6 ELSE 1.0 END) * (CASE WHEN followers > 100000 THEN 1.5 WHEN followers > 10000 THEN 1.2 ELSE 1.0 END)
  * (CASE WHEN retweets * 2 + likes + comments * 3 + score > 1000 THEN least(1.5, 1 + (retweets * 2 + likes + comments * 3 + score) / 10000.0) ELSE 1.0 END))"""
_FULL = "trim(concat_ws(' ', text, comments_text), ' ')"
_QUICK = f"greatest(-1.0, least(1.0, ({hits('text', POS)} - {hits('text', NEG)}) * 0.15))"
_SYMBOLS = US_SYMBOLS
ANALYZED = f"""an0 AS (SELECT *, {_FULL} AS full_text FROM art),
an1 AS (SELECT *, greatest(-0.5, least(0.5, ({hits('full_text', POS)} - {hits('full_text', NEG)}) * 0.08)) AS raw FROM an0),
an2 AS (SELECT *, CASE WHEN followers > 10000 THEN raw * 0.8 + raw * least(followers / 1e6, 0.2) ELSE raw END AS sc FROM an1),
an AS (SELECT *, CASE WHEN full_text = '' THEN 0.0 ELSE greatest(-1.0, least(1.0, sc)) END AS sentiment,
  CASE WHEN full_text = '' THEN NULL WHEN sc >= 0.35 THEN 'positive' WHEN sc <= -0.35 THEN 'negative' ELSE 'neutral' END AS sentiment_label, {_WEIGHT} AS weight FROM an2)"""


def tickers(text: str) -> str:
    listed = ", ".join(f"'{s}'" for s in _SYMBOLS)
    code = rf"list_transform(regexp_extract_all({text}, '\b(\d{{6}})\b', 1), lambda c: c || CASE WHEN c[1:2] IN ('00', '30') THEN '.SZ' ELSE '.SS' END)"
    other = rf"list_concat(regexp_extract_all({text}, '\$([A-Z]{{1,5}})\b', 1), list_filter(regexp_extract_all({text}, '\b([A-Z]{{1,5}})\b', 1), lambda w: w IN ({listed})))"
    return f"(CASE WHEN market = 'CN' THEN {code} ELSE {other} END)"


_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
TICKED = f"""tk0 AS (SELECT *, CASE WHEN known IS NULL THEN {tickers('full_text')} ELSE list_append({tickers('full_text')}, known) END AS every FROM an),
tk AS (SELECT seq, market, date, unnest({_DISTINCT.format('every')}) AS ticker, sentiment, weight FROM tk0)"""
RULES = """rules AS (SELECT * FROM (VALUES ('CN', 0.10, 30000.0, true), ('US', NULL, 20000.0, false), ('KR', 0.30, 50000.0, false), ('JP', 0.20, 30000.0, false))
  t(market, price_limit, min_amount, st_filter))"""
RULED = (
    stage("ruled0", {"volume_ratio_5": z(f"volume / {fl(rl('avg', 'volume', 5))}"), "pct_chg": f"close / {fl('lag(close) OVER o')} - 1", "n_bars": "count(*) OVER whole"}, "bars")
    + ",\nruled AS (SELECT * REPLACE (CASE WHEN symbol LIKE '%7' THEN 'ST ' || name ELSE name END AS name) FROM ruled0)"
)
_OK = {
    "name": "NOT regexp_matches(name, 'ST|退|暂停')",
    "limit": "coalesce(abs(pct_chg) <= price_limit * 0.995, true)",
    "up": "coalesce(NOT (market = 'CN' AND abs(pct_chg) > 0.0995), true)",
    "liquid": "coalesce(volume_ratio_5 >= 0.3, true)",
    "amount": "coalesce(amount >= min_amount, true)",
}


def pct(x: str, part: str) -> str:
    return f"((rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {part}))"


def _to_date(error: float = 0.002) -> str:
    """Bounds of each date: counts by bucket, summed over the dates up to it and then over buckets."""
    step, parts = f"ln({1 + error}::DOUBLE / {1 - error}::DOUBLE)", []
    first = f"(1 - ceil(ln(1e-12::DOUBLE) / {step}))"
    value = lambda b: f"CASE WHEN {b} = 0 THEN 0 ELSE sign({b}) * exp((abs({b}) - {first}) * {step}) * {1 - error} END"
    for c in FEATURES:
        place = f"CASE WHEN abs({c}) < 1e-12 THEN 0 ELSE sign({c}) * (ceil(ln(abs({c})) / {step}) + {first}) END"
        parts += [
            f"h_{c} AS (SELECT date, {place} AS b, count(*) AS n FROM feat WHERE {c} IS NOT NULL GROUP BY ALL)",
            f"g_{c} AS (SELECT d.date, k.b, coalesce(sum(n) OVER (PARTITION BY k.b ORDER BY d.date), 0) AS m FROM (SELECT DISTINCT date FROM h_{c}) d CROSS JOIN (SELECT DISTINCT b FROM h_{c}) k LEFT JOIN h_{c} h ON h.date = d.date AND h.b = k.b)",
            f"r_{c} AS (SELECT date, b, sum(m) OVER (PARTITION BY date ORDER BY b) AS upto, sum(m) OVER (PARTITION BY date) AS held FROM g_{c})",
            f"p_{c} AS (SELECT date, " + ", ".join(f"min(b) FILTER (upto > floor({q}::DOUBLE * (held - 1)::DOUBLE)) AS {name}" for name, q in (("lo", 0.01), ("hi", 0.99))) + f" FROM r_{c} GROUP BY date)",
            f"q_{c} AS (SELECT date, {value('lo')} AS lo_{c}, {value('hi')} AS hi_{c} FROM p_{c})",
        ]
    return ",\n".join(parts)


def _panel() -> dict[str, str]:
    base, lab, pred = stages(FEAT), stages(FEAT, LABELLED), stages(FEAT, LABELLED, PRED)
    last = stages(FEAT, LABELLED, PRED, LATEST)
    out = {
        "src_bars": select({c: c for c in ("open", "high", "low", "close", "volume", "amount", "turnover")} | {"pct_chg": f"close / {fl('lag(close) OVER o')} - 1"}, "bars", "market, symbol, name, industry, date", WIN),
        "universe_lpad": "SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS code, s_name AS name, round(s_acctbal / (SELECT sum(s_acctbal) FROM supplier), 8) AS weight FROM supplier",
        "macro_pivot": f"WITH {MACRO} SELECT * FROM macro",
        "cache_freshness_split": f"WITH {BARS}, l AS (SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol) SELECT symbol, last_date, CASE WHEN last_date >= (SELECT max(last_date) FROM l) - 5 THEN 'cached' ELSE 'fetch' END AS status FROM l",
        "trading_day": "SELECT d::DATE AS date, isodow(d) < 6 AND d::DATE IN (SELECT ts::DATE FROM events WHERE day(ts) != 15) AS trading FROM generate_series(DATE '2023-12-25', DATE '2024-02-10', INTERVAL 1 DAY) t(d)",
        "union_by_name": f"WITH {BARS} SELECT market, symbol, date, {r('close')} AS close, CASE WHEN market = 'CN' THEN 1 END::INT AS extra FROM bars",
        "distinct_symbols": f"WITH {BARS} SELECT market, count(DISTINCT symbol) AS symbols, count(DISTINCT date) AS dates FROM bars GROUP BY market",
        "label_t1": select({"label": "lead(close) OVER o / greatest(close, 1e-12) - 1"}, "bars", "symbol, date", WIN),
        "label_neutral": f"WITH {BARS}, l AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY date) / greatest(close, 1e-12) - 1 AS y FROM bars) SELECT symbol, date, {r('y - median(y) OVER (PARTITION BY market, date)')} AS label FROM l",
        "join_sentiment": f"WITH {BARS}, {DAILY} SELECT symbol, date, {r('close')} AS close, {r('coalesce(sentiment_score, 0)')} AS sentiment_score, least(coalesce(news_count, 0), 1000)::BIGINT AS news_count, {r('coalesce(sentiment_std, 0)')} AS sentiment_std FROM bars LEFT JOIN daily USING (symbol, date)",
        "join_macro": f"WITH {BARS}, {MACRO} SELECT symbol, date, {r('close')} AS close, coalesce(urgent, 0) AS urgent, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(unspecified, 0) AS unspecified, coalesce(low, 0) AS low FROM (SELECT symbol, date, close FROM bars) LEFT JOIN macro USING (date)",
        "macro_change": f"WITH {MACRO} SELECT date, " + ", ".join(f"{c}, {r(z(f'{c} / {fl(f"lag({c}) OVER (ORDER BY date)")} - 1'))} AS {c}_change" for c in ("urgent", "high", "medium", "unspecified", "low")) + " FROM macro",
        "clean_nonfinite": f"WITH {BARS} SELECT symbol, date, CASE WHEN day(date) % 5 = 0 OR day(date) % 7 = 0 OR day(date) % 11 = 0 THEN 0.0 ELSE {r('close')} END AS x FROM bars",
        "ts_zscore": select({c: z(f"({c} - {rl('avg', c, 60, 30)}) / ({rl('stddev_pop', c, 60, 30)} + 1e-10)") for c in ("close", "volume")}, "bars", "symbol, date", WIN),
        "ffill": f"WITH {BARS}, h AS (SELECT symbol, date, CASE WHEN day(date) % 3 != 0 THEN close END AS x FROM bars) SELECT symbol, date, {r('coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 0)')} AS x FROM h",
        "query_groups": f"WITH {BARS} SELECT market, date, count(*) AS n FROM bars GROUP BY market, date",
    }
    bounds = "q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in FEATURES) + " FROM feat)"
    clipped = {c: f"greatest(lo_{c}, least(hi_{c}, {c}))" for c in FEATURES}
    out["winsorize"] = select(clipped, "feat, q", "symbol, date", "", f"{base}, {bounds}")
    to_date, ends = _to_date(), {c: f"greatest(lo_{c}, least(hi_{c}, {c}))" for c in FEATURES}
    known = "feat" + "".join(f" LEFT JOIN q_{c} USING (date)" for c in FEATURES)
    out["winsorize_to_date"] = select({c: f"CASE WHEN {c} IS NOT NULL THEN {x} END" for c, x in ends.items()}, known, "symbol, date", "", f"{base}, {to_date}")
    out["cs_rank"] = select({c: pct(c, "date") for c in FEATURES}, "feat", "market, symbol, date", "", base)
    clip = "c AS (SELECT market, symbol, date, " + ", ".join(f"{x} AS {c}" for c, x in clipped.items()) + " FROM feat, q)"
    out["preprocess"] = select({c: pct(c, "date") for c in FEATURES}, "c", "market, symbol, date", "", f"{base}, {bounds}, {clip}")
    joined = f"{base}, {DAILY}, j AS (SELECT symbol, date, volume_ratio_5, coalesce(sentiment_score, 0) AS s FROM feat LEFT JOIN daily USING (symbol, date))"
    rolled = {f"sentiment_ma_{w}": f"avg(s) OVER w{w}" for w in (3, 5, 10)} | {
        "sentiment_std_5": "coalesce(stddev_samp(s) OVER w5, 0)",
        "sentiment_change": "coalesce(s - lag(s) OVER o, 0)",
        "sentiment_trend": "coalesce((s - lag(s, 2) OVER o) / 2, 0)",
        "sentiment_volume_interaction": "s * volume_ratio_5",
    }
    out["s_rolling"] = select(rolled, "j", "symbol, date", WIN, joined)
    ruled = stages(RULED, RULES)
    out |= {
        "filter_name_regex": f"WITH {ruled} SELECT symbol, date, name FROM ruled WHERE {_OK['name']}",
        "filter_min_history": f"WITH {ruled} SELECT symbol, date, n_bars FROM ruled WHERE n_bars >= 285",
        "filter_price_limit": f"WITH {ruled} SELECT symbol, date, {r('pct_chg')} AS pct_chg FROM ruled LEFT JOIN rules USING (market) WHERE {_OK['limit']}",
        "filter_limit_up": f"WITH {ruled} SELECT symbol, date, {r('pct_chg')} AS pct_chg FROM ruled WHERE {_OK['up']}",
        "filter_liquidity": f"WITH {ruled} SELECT symbol, date, {r('volume_ratio_5')} AS volume_ratio_5 FROM ruled WHERE {_OK['liquid']}",
        "filter_min_amount": f"WITH {ruled} SELECT symbol, date, {r('amount')} AS amount FROM ruled LEFT JOIN rules USING (market) WHERE {_OK['amount']}",
        "filter_market": f"WITH {ruled} SELECT market, symbol, date, {r('pct_chg')} AS pct_chg, n_bars FROM ruled r LEFT JOIN rules USING (market) WHERE date = (SELECT max(date) FROM ruled m WHERE m.market = r.market) AND ({_OK['name']} OR NOT st_filter) AND n_bars >= 60 AND {_OK['limit']} AND {_OK['up']} AND {_OK['liquid']} AND {_OK['amount']}",
        "latest_cross_section": f"WITH {last} SELECT market, symbol, date, {r('pred_ret')} AS pred_ret FROM latest",
        "pick_metrics": f"WITH {last}, p AS (SELECT * FROM latest ORDER BY pred_ret DESC, symbol LIMIT 10) SELECT count(*) AS n, {r('avg(pred_ret)')} AS avg_pred, {r('max(pred_ret)')} AS max_pred, {r('min(pred_ret)')} AS min_pred, {r('stddev_samp(pred_ret)')} AS std_pred FROM p",
    }
    best = "ORDER BY pred_ret DESC, symbol"
    divers = f"c AS (SELECT *, row_number() OVER (PARTITION BY market, industry {best}) AS k FROM latest), v AS (SELECT *, row_number() OVER (PARTITION BY market {best}) AS rank FROM c WHERE k <= 2)"
    out["diversified_topk"] = f"WITH {last}, {divers} SELECT market, symbol, industry, {r('pred_ret')} AS pred_ret, rank FROM v WHERE rank <= 10"
    quint = """g AS (SELECT *, row_number() OVER (ORDER BY pred_ret, date, symbol) AS rn, count(*) OVER () AS n FROM pred),
    qs AS (SELECT 'Q' || greatest(1, ceil((rn - 1) * 5 / (n - 1)))::INT AS grp, pred_ret, label FROM g WHERE n >= 10),
    qt AS (SELECT grp, avg(pred_ret) AS mean_pred, avg(label) AS mean_label, stddev_samp(label) AS std_label, count(label) AS n, avg((label > 0)::INT) AS hit_rate FROM qs GROUP BY grp)"""
    out["quintiles"] = f"WITH {pred}, {quint} SELECT grp, {r('mean_pred')} AS mean_pred, {r('mean_label')} AS mean_label, {r('std_label')} AS std_label, n, {r('hit_rate')} AS hit_rate FROM qt"
    out["long_short"] = f"WITH {pred}, {quint} SELECT {r('a.mean_label - b.mean_label')} AS spread, {r('(a.mean_label - b.mean_label) / sqrt(a.std_label ** 2 / a.n + b.std_label ** 2 / b.n)')} AS t_stat FROM qt a, qt b WHERE a.grp = 'Q1' AND b.grp = 'Q5'"
    top = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY date {best}) AS k FROM pred), ks AS (SELECT unnest([5, 10, 20, 30]) AS top_k),
    td AS (SELECT top_k, date, avg(label) AS ret, count(label) AS n FROM rk JOIN ks ON k <= top_k GROUP BY top_k, date HAVING count(label) >= top_k // 2)"""
    out["topk_daily"] = f"WITH {pred}, {top} SELECT date, {r('ret')} AS ret, n FROM td WHERE top_k = 10"
    out["cum_returns"] = f"WITH {pred}, {top} SELECT date, {r('ret')} AS ret, {r('product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS cum FROM td WHERE top_k = 10"
    sh = "CASE WHEN count(ret) >= 5 AND stddev_samp(ret) >= 1e-10 THEN sqrt(252.0) * avg(ret) / stddev_samp(ret) ELSE 0 END"
    out["sharpe"] = f"WITH {pred}, {top} SELECT {r(sh)} AS sharpe, count(ret) AS n_days FROM td WHERE top_k = 10 GROUP BY top_k"
    out["backtest_topk"] = f"WITH {pred}, {top} SELECT top_k, {r(sh)} AS sharpe, {r('product(1 + ret)')} AS final_cum, count(ret) AS n_days, {r('avg(ret)')} AS avg_daily_ret FROM td GROUP BY top_k"
    idx = "ix AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"
    folds = f"""{idx}, fd AS (SELECT fold, date, nth - fold * (n // 4) AS tail FROM ix, (SELECT unnest([1, 2, 3]) AS fold)),
    fp AS (SELECT fold, date, tail, CASE WHEN tail < 0 THEN 'train' WHEN tail >= 5 AND tail < 5 + (SELECT max(n) // 4 FROM ix) THEN 'val' END AS part FROM fd)"""
    out["cv_folds"] = f"""WITH {BARS}, {folds} SELECT fold, count(*) FILTER (part = 'train') AS train_rows, count(*) FILTER (part = 'val') AS val_rows, max(date) FILTER (part = 'train') AS train_last,
      min(date) FILTER (part = 'val') AS val_first, max(date) FILTER (part = 'val') AS val_last FROM bars JOIN fp USING (date) GROUP BY fold
      HAVING count(*) FILTER (part = 'train') >= 100 AND count(*) FILTER (part = 'val') >= 10"""
    out["cv_purge_anti"] = f"""WITH {BARS}, {folds}, b AS (SELECT fold, symbol, tail, part FROM bars JOIN fp USING (date)) SELECT fold, symbol, count(*) AS n FROM b
      WHERE part = 'val' AND NOT EXISTS (SELECT 1 FROM b t WHERE t.part = 'train' AND t.tail >= -1 AND t.fold = b.fold AND t.symbol = b.symbol) GROUP BY fold, symbol"""
    wins = f"""{idx}, wf AS (SELECT s.nth AS start, min(i.date) FILTER (i.nth < s.nth + 104) AS train_first, max(i.date) FILTER (i.nth < s.nth + 104) AS train_last,
      min(i.date) FILTER (i.nth >= s.nth + 104) AS test_first, max(i.date) FILTER (i.nth >= s.nth + 104) AS test_last
      FROM ix s JOIN ix i ON i.nth >= s.nth AND i.nth < s.nth + 109 WHERE s.nth % 5 = 0 AND s.nth < s.n - 104 GROUP BY s.nth)"""
    out["wfa_windows"] = f"WITH {BARS}, {wins} SELECT * FROM wf"
    out["wfa_linear"] = f"""WITH {lab}, {wins}, ok AS (SELECT * FROM lab WHERE label IS NOT NULL),
      ft AS (SELECT start, test_first, test_last, regr_slope(label, close_ma_5_ratio) AS b, regr_intercept(label, close_ma_5_ratio) AS a FROM ok JOIN wf ON date BETWEEN train_first AND train_last GROUP BY ALL)
      SELECT symbol, date, start, {r('b * close_ma_5_ratio + a')} AS pred_ret FROM ok JOIN ft ON date BETWEEN test_first AND test_last"""
    avg_rank = lambda x: f"rank() OVER (PARTITION BY name ORDER BY {x}) + (count(*) OVER (PARTITION BY name, {x}) - 1) / 2.0"
    ics = f"""un AS (UNPIVOT (SELECT label, {', '.join(FEATURES)} FROM lab WHERE label IS NOT NULL) ON {', '.join(FEATURES)} INTO NAME name VALUE value),
      rx AS (SELECT name, {avg_rank('value')} AS a, {avg_rank('label')} AS b FROM un), ic AS (SELECT name, corr(a, b) AS ic, count(*) AS n FROM rx GROUP BY name)"""
    out["rank_ic"] = f"WITH {lab}, {ics} SELECT 'pred_ret' AS name, {r('ic')} AS ic, n FROM ic WHERE name = 'close_ma_5_ratio'"
    out["ic_topn"] = f"WITH {lab}, {ics} SELECT name, {r('ic')} AS ic, n FROM ic ORDER BY abs(ic) DESC, name LIMIT 3"
    out["ic_report"] = f"WITH {lab}, {ics} SELECT name, {r('CASE WHEN n >= 10 THEN ic ELSE 0 END')} AS ic, n, {r('CASE WHEN n >= 10 AND abs(ic) < 1 THEN ic * sqrt((n - 2) / (1 - ic * ic)) ELSE 0 END')} AS t_stat FROM ic"
    out["listed_symbols"] = f"WITH {BARS} SELECT DISTINCT market, symbol, CASE WHEN market != 'CN' THEN symbol WHEN symbol[1:2] IN ('00', '30') THEN symbol || '.SZ' ELSE symbol || '.SS' END AS listed FROM bars"
    out["ic_prune"] = f"WITH {lab}, {ics} SELECT name, {r('ic')} AS ic, n, abs(ic) >= 0.01 OR row_number() OVER (ORDER BY abs(ic) DESC, name) <= 2 AS kept FROM ic"
    out["ndcg_at_k"] = f"""WITH {pred}, gr AS (SELECT *, least(4, floor({pct('label', 'date')} * 5)) AS rel FROM pred),
      od AS (SELECT *, row_number() OVER (PARTITION BY date {best}) AS a, row_number() OVER (PARTITION BY date ORDER BY rel DESC, symbol) AS b FROM gr),
      sm AS (SELECT date, sum(CASE WHEN a <= 10 THEN (2 ** rel - 1) / log2(a + 1) ELSE 0 END) AS dcg, sum(CASE WHEN b <= 10 THEN (2 ** rel - 1) / log2(b + 1) ELSE 0 END) AS ideal FROM od GROUP BY date)
      SELECT date, {r('CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END')} AS ndcg FROM sm"""
    out["stack_ridge"] = f"""WITH {lab}, y AS (SELECT close_ma_5_ratio AS u, momentum_10d AS v, label AS w FROM lab WHERE label IS NOT NULL), c AS (SELECT avg(u) AS mu, avg(v) AS mv, avg(w) AS mw FROM y),
      s AS (SELECT count(*) AS n, sum((u - mu) ** 2) + 1 AS a, sum((v - mv) ** 2) + 1 AS b, sum((u - mu) * (v - mv)) AS k, sum((u - mu) * (w - mw)) AS d, sum((v - mv) * (w - mw)) AS e FROM y, c),
      g AS (SELECT n, (b * d - k * e) / (a * b - k * k) AS w1, (a * e - k * d) / (a * b - k * k) AS w2 FROM s)
      SELECT n, {r('w1')} AS w1, {r('w2')} AS w2, {r('mw - w1 * mu - w2 * mv')} AS intercept FROM g, c"""
    out["slot_1330"] = f"""WITH {stages(FEAT, LABELLED, PRED.replace("WHERE label", "WHERE market = 'CN' AND label"), LATEST)}, {divers}, {_signals(24, 'sg')}, one AS (SELECT max(current) AS cur, coalesce(max(signal), 'no_data') AS sg FROM sg WHERE market = 'CN')
      SELECT symbol, rank, {r('pred_ret')} AS pred_ret, sg AS sentiment_signal, CASE WHEN coalesce(cur, 0) > -0.2 THEN 'buy' ELSE 'buy_reduced' END AS action, rank <= 5 AS published FROM v, one WHERE rank <= 10"""
    return out


def _signals(hours: int, name: str, snap: bool = True) -> str:
    since = f"TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {hours} HOUR"
    pre = f"{SNAP}, " if snap else ""
    return f"""{pre}{name}0 AS (SELECT * FROM (SELECT * FROM snap WHERE timestamp >= {since}) QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', timestamp), market ORDER BY timestamp DESC, seq DESC) = 1),
{name}1 AS (SELECT market, list(sentiment_score ORDER BY timestamp, seq) AS l, stddev_pop(sentiment_score) AS volatility FROM {name}0 GROUP BY market),
{name}2 AS (SELECT market, len(l) AS n, len(l) >= 3 AS known, CASE WHEN known THEN l[-1] END AS current, CASE WHEN known THEN list_avg(l[-3:]) END AS recent_avg, CASE WHEN known THEN l[-1] - l[-2] END AS trend_latest,
  CASE WHEN known THEN l[-1] - l[1] END AS trend_all, CASE WHEN known THEN s.volatility END AS volatility FROM {name}1 s),
{name}3 AS (SELECT *, CASE WHEN n < 3 THEN 'insufficient_data' WHEN current > 0.15 AND trend_latest >= 0 THEN 'bullish' WHEN current < -0.15 AND trend_latest <= 0 THEN 'bearish'
  WHEN trend_all > 0.1 AND current > -0.05 THEN 'improving' WHEN trend_all < -0.1 AND current < 0.05 THEN 'deteriorating' ELSE 'neutral' END AS signal FROM {name}2),
{name} AS (SELECT *, CASE signal WHEN 'insufficient_data' THEN 0 WHEN 'neutral' THEN 0.3 WHEN 'improving' THEN least(1, 0.5 + abs(trend_all) / 0.4) WHEN 'deteriorating' THEN least(1, 0.5 + abs(trend_all) / 0.4)
  ELSE least(1, 0.5 + abs(current) + abs(trend_all) / 0.3) END AS confidence FROM {name}3)"""


FEED = r"""item AS (SELECT doc_id AS d, coalesce(substr(text, 1, 80), '') AS title, coalesce(substr(text, 81), '') AS about, 'https://ex.org/' || doc_id AS url, source,
  CASE lang WHEN 'en' THEN 'US' WHEN 'de' THEN 'KR' WHEN 'fr' THEN 'JP' WHEN 'es' THEN 'CN' END AS market, lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS day,
  round(((doc_id * 37) % 201 - 100) / 100.0, 2) + 0 AS score, CASE WHEN (doc_id * 37) % 201 > 100 THEN 'up' ELSE 'down' END AS label FROM documents),
plain AS (SELECT * REPLACE (regexp_replace(title, '^\s+|\s+$', '', 'g') AS title, regexp_replace(about, '^\s+|\s+$', '', 'g') AS about) FROM item),
news AS (SELECT *, regexp_replace(title || ' ' || about, '^\s+|\s+$', '', 'g') AS text FROM plain)"""


def _feeds() -> dict[str, str]:
    return {
        "feed_scored": f"WITH {FEED} SELECT url, market, title, substr(about, 1, 500) AS summary, substr(title || ' ' || about, 1, 2000) AS text, '2024-01-' || day || 'T08:30:15' AS published, {r('score')} AS sentiment, label AS sentiment_label, {r('score')} AS apple, 0.0::DOUBLE AS visa, 2::INT AS n_tickers FROM item",
        "feed_news": f"WITH {FEED} SELECT url, market, coalesce(source, '') AS source_name, title, substr(about, 1, 500) AS summary, substr(text, 1, 2000) AS text, '2024-01-' || day AS published, CASE WHEN market = 'CN' THEN 'zh' ELSE 'en' END AS language, {r(_QUICK)} AS sentiment, {hits('text', ('the', 'Tion', 'zzz'))}::DOUBLE AS relevance FROM news WHERE text != ''",
        "feed_daily": f"WITH {FEED} SELECT ('2024-01-' || day)::DATE AS date, lpad((d // 40 % 7 + 1)::VARCHAR, 6, '0') AS symbol, {r('avg(score)')} AS sentiment_score, count(*) AS news_count FROM item GROUP BY 1, 2",
        "strongest_articles": f"WITH {FEED} SELECT url, {r('score')} AS sentiment FROM item ORDER BY abs(score) DESC, url, title LIMIT 40",
    }


def _text() -> dict[str, str]:
    an, tk = f"{ART}, {ANALYZED}", f"{ART}, {ANALYZED}, {TICKED}"
    watched = hits("text", ("the", "Tion", "zzz"))
    words = ", ".join(f"('{w}', {s})" for ws, s in ((POS, 1), (NEG, -1)) for w in ws)
    extracted = f"SELECT *, {tickers('text')} AS every FROM art"
    return {
        "rss_normalize": f"WITH {ART} SELECT seq, source, market, title, substr(text, 1, 500) AS summary, url FROM art WHERE type = 'rss' AND trim(text) != '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) <= 20",
        "source_quota": f"WITH {ART} SELECT seq, source, likes FROM art WHERE type = 'social' QUALIFY row_number() OVER (PARTITION BY source ORDER BY likes DESC, seq) <= 8",
        "comment_concat": "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations WHERE turn IS NOT NULL) SELECT conv_id, coalesce(max(text) FILTER (k = 1), '') AS title, substr(coalesce(string_agg(coalesce(text, ''), ' ' ORDER BY k) FILTER (k BETWEEN 2 AND 21), ''), 1, 2000) AS comments FROM c GROUP BY conv_id",
        "html_links": r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)[1:50] AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)[1:50] AS a FROM pages),
          u AS (SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(a) AS anchor FROM l) SELECT page_id, pos, href, anchor FROM u WHERE trim(anchor, ' ') != ''""",
        "quick_sentiment": f"WITH {ART} SELECT seq, {r(_QUICK)} AS quick FROM art",
        "keyword_relevance": f"WITH {ART} SELECT seq, {watched}::BIGINT AS relevance FROM art",
        "lexicon_boost": f"WITH {ART} SELECT seq, {r(f'greatest(-1.0, least(1.0, greatest(-1.0, least(1.0, score / 100.0 - 2)) + greatest(-0.5, least(0.5, ({hits("text", POS)} - {hits("text", NEG)}) * 0.08))))')} AS boosted FROM art",
        "lexicon_theta_join": f"WITH {ART} SELECT market, word, sign, count(*) AS n FROM art JOIN (VALUES {words}) w(word, sign) ON contains(lower(text), word) GROUP BY market, word, sign",
        "analyze_items": f"WITH {an} SELECT seq, {r('sentiment')} AS sentiment, sentiment_label FROM an",
        "article_weight": f"WITH {ART} SELECT seq, {r(_WEIGHT)} AS weight FROM art",
        "extract_tickers": f"WITH {ART}, e AS ({extracted}) SELECT seq, coalesce(array_to_string({_DISTINCT.format('every')}, ','), '') AS tickers FROM e",
        "json_ticker_map": f"WITH {ART}, e AS (SELECT *, CASE WHEN known IS NULL THEN {tickers('text')} ELSE list_append({tickers('text')}, known) END AS every FROM art) SELECT seq, coalesce(array_to_string({_DISTINCT.format('every')}, ','), '') AS tickers, known_score AS score, CASE WHEN known_score > 0 THEN 'up' WHEN known IS NOT NULL THEN 'down' END AS label FROM e",
        "resolve_date": f"WITH {ART} SELECT seq, date FROM art",
        "av_timestamp": f"WITH {ART} SELECT seq, CASE WHEN seq % 9 = 0 THEN '2024' ELSE '2024-01-' || lpad((seq % 28 + 1)::VARCHAR, 2, '0') || 'T08:30:15' END AS iso FROM art",
        "url_dedup": f"WITH {ART} SELECT seq, url FROM art QUALIFY url = '' OR row_number() OVER (PARTITION BY url ORDER BY seq) = 1",
        "topk_extreme": f"WITH {ART} SELECT seq, {r(_QUICK)} AS quick, {watched}::BIGINT AS relevance FROM art ORDER BY abs(round({_QUICK}, 6)) DESC, relevance DESC, seq LIMIT 50",
        "ticker_sentiment": f"WITH {tk} SELECT ticker, {r('sum(sentiment * weight) / sum(weight)')} AS sentiment_score, count(*) AS news_count, {r('stddev_pop(sentiment)')} AS sentiment_std, {r('avg((sentiment > 0.15)::INT)')} AS positive_share, {r('avg((sentiment < -0.15)::INT)')} AS negative_share, {r('avg((sentiment BETWEEN -0.15 AND 0.15)::INT)')} AS neutral_share FROM tk GROUP BY ticker",
        "temporal_sentiment": f"WITH {tk} SELECT date, ticker, {r('avg(sentiment)')} AS sentiment_score, count(*) AS news_count, {r('stddev_pop(sentiment)')} AS sentiment_std, {r('max(sentiment)')} AS max_score, {r('min(sentiment)')} AS min_score FROM tk GROUP BY date, ticker",
        "market_sentiment": f"WITH {an} SELECT market, {r('sum(sentiment * weight) / sum(weight)')} AS market_score, count(*) AS n FROM an GROUP BY market",
        "snapshot_score": f"WITH {tk}, m AS (SELECT market, sum(sentiment * weight) / sum(weight) AS s FROM an GROUP BY market), dy AS (SELECT market, date, ticker, avg(sentiment) AS s FROM tk GROUP BY market, date, ticker), da AS (SELECT market, avg(s) AS a FROM dy GROUP BY market) SELECT market, {r('coalesce(a, s)')} AS snapshot_score FROM m LEFT JOIN da USING (market)",
        "top_tickers": f"WITH {tk}, s AS (SELECT market, ticker, round(avg(sentiment), 9) + 0 AS sc, count(*) AS news_count FROM tk GROUP BY market, ticker) SELECT market, ticker, {r('sc')} AS sentiment_score, news_count, row_number() OVER (PARTITION BY market ORDER BY abs(sc) DESC, ticker) AS rank FROM s QUALIFY rank <= 10",
        "source_counts": f"WITH {ART} SELECT coalesce(source_cn, source) AS source, count(*) AS n FROM art GROUP BY 1",
        "sentiment_daily": f"WITH {DAILY} SELECT date, symbol, {r('sentiment_score')} AS sentiment_score, news_count, {r('sentiment_std')} AS sentiment_std FROM daily",
        "sentiment_merge": f"WITH {DAILY}, u AS (SELECT date, symbol, sentiment_score, news_count FROM daily UNION ALL SELECT date, symbol, sentiment_score / 2, news_count FROM daily WHERE news_count > 1) SELECT date, symbol, {r('avg(sentiment_score)')} AS sentiment_score, sum(news_count)::BIGINT AS news_count FROM u GROUP BY date, symbol",
    }


def _timeline() -> dict[str, str]:
    as_of = "TIMESTAMP '2024-01-31 00:00:00'"
    tz = "timestamp"
    since = lambda h: f"SELECT * FROM snap WHERE timestamp >= {as_of} - INTERVAL {h} HOUR"
    curve = lambda h: f"{SNAP}, c AS (SELECT * FROM ({since(h)}) QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', timestamp), market ORDER BY timestamp DESC, seq DESC) = 1)"
    o = "(PARTITION BY market ORDER BY timestamp, seq)"
    last, first = "arg_max(sentiment_score, (timestamp, seq))", "arg_min(sentiment_score, (timestamp, seq))"
    minute = "(hour(timestamp + INTERVAL 8 HOUR) * 60 + minute(timestamp + INTERVAL 8 HOUR))"
    one = lambda n, m, p: f"{p} AS (SELECT max(current) AS {p}_cur, max(recent_avg) AS {p}_avg, max(trend_all) AS {p}_all, max(volatility) AS {p}_vol, max(signal) AS {p}_sig FROM {n} WHERE market = '{m}')"
    return {
        "cache_fresh": f"WITH {SNAP} SELECT market, max({tz}) AS last_ts, max(timestamp) > TIMESTAMP '2024-01-30 23:00:00' AS fresh FROM snap GROUP BY market",
        "hour_dedup": f"WITH {SNAP} SELECT market, {tz} AS timestamp, seq, {r('sentiment_score')} AS sentiment_score, article_count FROM hourly",
        "recent_hours": f"WITH {SNAP} " + " UNION ALL ".join(f"SELECT market, count(*) AS n, {r('avg(sentiment_score)')} AS mean, {h}::INT AS hours FROM ({since(h)}) GROUP BY market" for h in (4, 24, 48)),
        "poll_gaps": f"WITH {SNAP}, g AS (SELECT market, lag(timestamp) OVER {o} AS a, timestamp AS b FROM hourly) SELECT market, a AS gap_start, b AS gap_end, {r('epoch_us(b - a) / 3.6e9')} AS gap_hours FROM g WHERE epoch_us(b - a) / 3.6e9 > 1.5",
        "curve_smooth": f"WITH {curve(72)} SELECT market, seq, {r(f'CASE WHEN count(*) OVER (PARTITION BY market) >= 3 THEN (coalesce(lag(sentiment_score) OVER {o}, 0) + sentiment_score + coalesce(lead(sentiment_score) OVER {o}, 0)) / 3 ELSE sentiment_score END')} AS smooth FROM c",
        "curve_features": f"WITH {curve(72)} SELECT market, seq, {r(f'coalesce(sentiment_score - lag(sentiment_score) OVER {o}, 0)')} AS trend, {r('coalesce(stddev_samp(sentiment_score) OVER (PARTITION BY market ORDER BY timestamp, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0)')} AS volatility FROM c",
        "curve_snapshot": f"WITH {curve(24)} SELECT market, {r(last)} AS last, {r('min(sentiment_score)')} AS low, {r('max(sentiment_score)')} AS high, {r('avg(sentiment_score)')} AS mean, {r('stddev_samp(sentiment_score)')} AS std, {r(f'{last} - {first}')} AS trend, count(*) AS n, min({tz}) AS first_ts, max({tz}) AS last_ts FROM c GROUP BY market",
        "sentiment_summary": f"WITH {curve(24)}, s AS (SELECT market, {last} AS cur, sum(article_count)::BIGINT AS articles, count(*) AS n, {r(f'{last} - {first}')} AS change FROM c GROUP BY market) SELECT market, {r('cur')} AS current, articles, n, change, CASE WHEN cur > 0.15 THEN 'bullish' WHEN cur < -0.15 THEN 'bearish' ELSE 'neutral' END AS verdict FROM s",
        "curve_display": f"WITH {curve(72)} SELECT market, row_number() OVER (PARTITION BY market ORDER BY timestamp DESC, seq DESC) AS n, {tz} AS timestamp, {r('c.sentiment_score')} AS sentiment_score, CASE WHEN c.sentiment_score > 0.05 THEN '+' WHEN c.sentiment_score < -0.05 THEN '-' ELSE '=' END AS marker FROM c QUALIFY n <= 5",
        "trading_hour": f"WITH {SNAP} SELECT seq, hour(timestamp + INTERVAL 8 HOUR) BETWEEN 9 AND 15 AND isodow(timestamp) < 6 AS trading FROM snap",
        "detect_slot": f"WITH {SNAP} SELECT seq, CASE WHEN {minute} BETWEEN 420 AND 435 THEN '0700' WHEN {minute} BETWEEN 565 AND 580 THEN '0925' WHEN {minute} BETWEEN 810 AND 825 THEN '1330' WHEN {minute} BETWEEN 595 AND 605 THEN '0955' ELSE 'idle' END AS slot FROM snap",
        "signal_stats": f"WITH {_signals(24, 'sg')} SELECT market, {r('current')} AS current, {r('recent_avg')} AS recent_avg, {r('trend_latest')} AS trend_latest, {r('trend_all')} AS trend_all, {r('volatility')} AS volatility, n FROM sg",
        "market_signal": f"WITH {_signals(24, 'sg')} SELECT market, signal, {r('confidence')} AS confidence FROM sg",
        "slot_0700": f"WITH {_signals(12, 'sg')}, {one('sg', 'CN', 'a')}, {one('sg', 'US', 'b')}, x AS (SELECT *, coalesce(a_cur, 0) * 0.6 + coalesce(b_cur, 0) * 0.4 AS c FROM a, b) SELECT {r('c')} AS combined, CASE WHEN c > 0.1 THEN 'positive' WHEN c < -0.1 THEN 'negative' ELSE 'neutral' END AS assessment, CASE WHEN abs(c) < 0.1 THEN 'low' WHEN abs(c) < 0.3 THEN 'medium' ELSE 'high' END AS risk_level, a_sig AS cn_signal, b_sig AS us_signal FROM x",
        "slot_0925": f"WITH {_signals(24, 'sd')}, {_signals(4, 'sh', snap=False)}, {one('sd', 'CN', 'a')}, {one('sh', 'CN', 'b')}, x AS (SELECT coalesce(a_avg, 0) * 0.4 + coalesce(b_avg, 0) * 0.3 + coalesce(a_all, 0) * 0.3 AS c FROM a, b) SELECT {r('c')} AS blended, CASE WHEN c > 0.15 THEN 'positive' WHEN c < -0.15 THEN 'negative' ELSE 'neutral' END AS verdict, CASE WHEN c > -0.2 THEN 'proceed' ELSE 'caution' END AS action FROM x",
        "slot_0955": f"WITH {_signals(12, 'sg')}, {one('sg', 'CN', 'a')}, {one('sg', 'US', 'b')}, x AS (SELECT coalesce(a_cur, 0) > -0.2 AS sentiment_ok, coalesce(b_sig, 'neutral') NOT IN ('bearish', 'deteriorating') AS us_stable, coalesce(a_vol, 0) < 0.3 AS volatility_ok, a_cur IS NOT NULL AND b_sig IS NOT NULL AS data_ok FROM a, b) SELECT *, CASE WHEN sentiment_ok AND us_stable AND volatility_ok THEN 'SELL' ELSE 'HOLD_CAUTION' END AS decision FROM x",
        "yesterday_buys": "SELECT ts::DATE AS entry_date, event_id AS seq, lpad((user_id % 100 + 1)::VARCHAR, 6, '0') AS top_symbol, (user_id % 100)::VARCHAR AS pick FROM events WHERE event_id % (day(ts) % 4 + 1) = 2 AND ts::DATE BETWEEN DATE '2024-01-18' AND DATE '2024-01-19' ORDER BY ts::DATE DESC, ts, event_id LIMIT 1",
        "slot_status": "WITH s AS (SELECT * FROM (VALUES ('0700', 7), ('0925', 9), ('0955', 9), ('1330', 13)) t(slot, due)), d AS (SELECT DISTINCT (['0700', '0925', '1330', '0955'])[(event_id % (day(ts) % 4 + 1) + 1)::INT] AS slot FROM events WHERE ts::DATE = DATE '2024-01-20') SELECT slot, CASE WHEN slot IN (SELECT slot FROM d) THEN 'done' WHEN 10 > due THEN 'missed' ELSE 'waiting' END AS status FROM s",
    }


#: Columns of dates and of times by query; both sides return them as text.
_DATES = {name: ("date",) for name in (
    "src_bars macro_pivot trading_day union_by_name label_t1 label_neutral join_sentiment join_macro macro_change clean_nonfinite ts_zscore ffill query_groups winsorize "
    "cs_rank preprocess s_rolling filter_name_regex filter_min_history filter_price_limit filter_limit_up filter_liquidity filter_min_amount filter_market "
    "latest_cross_section topk_daily cum_returns wfa_linear ndcg_at_k sentiment_daily sentiment_merge"
).split()} | {
    "cache_freshness_split": ("last_date",),
    "winsorize_to_date": ("date",),
    "cv_folds": ("train_last", "val_first", "val_last"),
    "wfa_windows": ("train_first", "train_last", "test_first", "test_last"),
    "yesterday_buys": ("entry_date",),
    "feed_daily": ("date",),
}
_TIMES = {"cache_fresh": ("last_ts",), "hour_dedup": ("timestamp",), "poll_gaps": ("gap_start", "gap_end"), "curve_snapshot": ("first_ts", "last_ts"), "curve_display": ("timestamp",)}


def _written(name: str, sql: str) -> str:
    dates = ("date",) if name.startswith("f_") else _DATES.get(name, ())
    texts = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in _TIMES.get(name, ())]
    return f"SELECT * REPLACE ({', '.join(texts)}) FROM ({sql})" if texts else sql


def oracle_sql() -> dict[str, str]:
    from quantloom.plans import fitting_sql, flow_sql  # which build on the SQL here

    every = _factors() | _panel() | _feeds() | _text() | _timeline()
    return {name: _written(name, sql) for name, sql in every.items()} | flow_sql.oracle_sql() | fitting_sql.oracle_sql()
