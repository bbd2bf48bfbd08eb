"""Rolling factors of the bar panel.

Every family is a function from bars to bars with further columns.  All of them use the
same window (symbol, date), so families share an exchange and a sort; values that later windows
need (returns, deltas, logs) are columns of an earlier projection.  Regressions and correlations
are moments of Arrow batches (``rolling``), each with an exchange of its own in a panel.
Factors look at past rows only, but for ``amount``, which decides by the symbol's whole sum
whether there are amounts at all; a missing window gives 0, the label stays null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import EPS, by_date, frame, guarded, over_floor, over_shifted, quantile_of, rolling, shifted, sorted_frame, with_emas
from quantloom.functions.rolling import correlation, on_time, rolled
from quantloom.functions.session import dealt

MA = (3, 5, 10, 20, 30, 60)
ROC = (5, 10, 20, 60)
STD = (5, 10, 20)
MOMENTUM = (1, 5, 10, 20)
WINDOWS = (5, 10, 20, 30, 60)


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def _prior_close() -> Column:
    return shifted("close")


def ma(bars: DataFrame, windows=MA) -> DataFrame:
    """ma_w, and how far the close is from it."""
    bars = bars.withColumns({f"ma_{w}": rolling(F.avg, "close", w) for w in windows})
    ratios = {f"close_ma_{w}_ratio": _zero(over_floor("close", f"ma_{w}") - 1) for w in windows}
    return bars.withColumns(ratios | {f"ma_{w}": _zero(F.col(f"ma_{w}")) for w in windows})


def roc(bars: DataFrame, windows=ROC) -> DataFrame:
    return bars.withColumns({f"roc_{w}": _zero(over_floor(F.col("close") - shifted("close", w), shifted("close", w))) for w in windows})


def volatility(bars: DataFrame, windows=STD) -> DataFrame:
    """Spread of the returns, which are taken over the current close."""
    bars = bars.withColumn("ret", _zero(over_floor(F.col("close") - _prior_close(), "close")))
    return bars.withColumns({f"volatility_{w}": _zero(rolling(F.stddev_pop, "ret", w)) for w in windows}).drop("ret")


def bollinger(bars: DataFrame, w: int = 20) -> DataFrame:
    bars = bars.withColumns({"_mean": rolling(F.avg, "close", w), "_sd": rolling(F.stddev_pop, "close", w)})
    out = {"bb_position": _zero(guarded(F.col("close") - F.col("_mean"), "_sd") / 2), "bb_width": _zero(over_floor("_sd", "_mean"))}
    return bars.withColumns(out).drop("_mean", "_sd")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    bars = with_emas(bars, {"_fast": ("close", fast), "_slow": ("close", slow)}).withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    bars = with_emas(bars, {"macd_signal": ("macd", signal)})
    return bars.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Exponential means of gains and losses; 50 where there is no change yet."""
    delta = F.col("close") - _prior_close()
    bars = bars.withColumns({"_gain": F.greatest(delta, F.lit(0.0)), "_loss": F.greatest(-delta, F.lit(0.0)), "_delta": delta})
    bars = bars.withColumns({"_gain": F.when(F.col("_delta").isNotNull(), F.col("_gain")), "_loss": F.when(F.col("_delta").isNotNull(), F.col("_loss"))})
    bars = with_emas(bars, {"_up": ("_gain", period), "_down": ("_loss", period)})
    value = 100 - 100 / (1 + over_floor("_up", "_down", 1e-10))
    return bars.withColumn(f"rsi_{period}", F.coalesce(value, F.lit(50.0))).drop("_gain", "_loss", "_delta", "_up", "_down")


def cci(bars: DataFrame, w: int = 20) -> DataFrame:
    """Typical price against its mean; the deviation is that of each row from its own mean."""
    bars = bars.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    bars = bars.withColumn("_sma", rolling(F.avg, "_tp", w)).withColumn("_off", F.abs(F.col("_tp") - F.col("_sma")))
    bars = bars.withColumn("_mad", rolling(F.avg, "_off", w))
    return bars.withColumn(f"cci_{w}", _zero(guarded(F.col("_tp") - F.col("_sma"), "_mad") / 0.015)).drop("_tp", "_sma", "_off", "_mad")


def atr(bars: DataFrame, w: int = 14) -> DataFrame:
    before = F.coalesce(_prior_close(), F.col("close"))
    bars = bars.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    bars = bars.withColumn(f"atr_{w}", _zero(rolling(F.avg, "_tr", w)))
    return bars.withColumn("atr_pct", over_floor(f"atr_{w}", "close")).drop("_tr")


def price_position(bars: DataFrame, w: int = 20) -> DataFrame:
    high, low = F.max("high").over(frame(w)), F.min("low").over(frame(w))
    bars = bars.withColumns({f"high_{w}": high, f"low_{w}": low})
    place = guarded(F.col("close") - F.col(f"low_{w}"), F.col(f"high_{w}") - F.col(f"low_{w}"))
    return bars.withColumn(f"price_position_{w}", F.coalesce(place, F.lit(0.5)))


def volume(bars: DataFrame) -> DataFrame:
    bars = bars.withColumns({f"volume_ma_{w}": _zero(rolling(F.avg, "volume", w)) for w in (5, 20)})
    return bars.withColumns(
        {"volume_ratio_5": over_floor("volume", "volume_ma_5"), "volume_change_1": _zero(over_floor("volume", shifted("volume")) - 1)}
    ).withColumn("volume_ratio_5", F.when(F.col("volume_ma_5") > 0, F.col("volume_ratio_5")).otherwise(0.0))


def amount(bars: DataFrame, w: int = 20) -> DataFrame:
    """Means of turnover and amount, for symbols that have any."""
    whole = Window.partitionBy("symbol")
    means = {f"{c}_ma_{w}": F.when(F.sum(c).over(whole) > 0, rolling(F.avg, c, w)) for c in ("turnover", "amount")}
    bars = bars.withColumns(means)
    return bars.withColumns({f"{c}_ratio": _zero(over_floor(c, f"{c}_ma_{w}")) for c in ("turnover", "amount")} | {f"{c}_ma_{w}": _zero(F.col(f"{c}_ma_{w}")) for c in ("turnover", "amount")})


def momentum(bars: DataFrame, windows=MOMENTUM) -> DataFrame:
    out = {f"momentum_{w}d": _zero(over_floor("close", shifted("close", w)) - 1) for w in windows}
    return bars.withColumns(out | {"amplitude": over_floor(F.col("high") - F.col("low"), "close")})


def kbar(bars: DataFrame) -> DataFrame:
    """Shapes of the candle."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span, top, bottom = h - lo, F.greatest(o, c), F.least(o, c)
    return bars.withColumns(
        {
            "KMID": over_floor(c - o, o),
            "KLEN": over_floor(span, o),
            "KMID2": over_shifted(c - o, span),
            "KUP": over_floor(h - top, o),
            "KUP2": over_shifted(h - top, span),
            "KLOW": over_floor(bottom - lo, o),
            "KLOW2": over_shifted(bottom - lo, span),
            "KSFT": over_floor(2 * c - h - lo, o),
            "KSFT2": over_shifted(2 * c - h - lo, span),
        }
    )


def regression(bars: DataFrame, windows=WINDOWS, kinds=("BETA", "RSQR", "RESI")) -> DataFrame:
    """Slope, fit and newest residual of the close on time, for full windows."""
    bars = rolled(bars, ["close"], windows, ["_b", "_m", "_v"], on_time)
    out = {}
    for w in windows:
        b, m, v = F.col(f"_b_{w}"), F.col(f"_m_{w}"), F.col(f"_v_{w}")
        if "BETA" in kinds:
            out[f"BETA_{w}"] = _zero(over_floor(b, "close"))
        if "RSQR" in kinds:
            # Time has variance (w * w - 1) / 12, so the explained part follows from the slope.
            out[f"RSQR_{w}"] = _zero(b * b * (w * (w * w - 1) / 12.0) / v)
        if "RESI" in kinds:
            out[f"RESI_{w}"] = _zero(over_floor(F.col("close") - (m + b * ((w - 1) / 2.0)), "close"))
    return bars.withColumns(out).drop(*(f"_{x}_{w}" for w in windows for x in "bmv"))


def quantile(bars: DataFrame, windows=WINDOWS) -> DataFrame:
    first = F.first("close").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    bars = bars.withColumns({f"_s{w}": sorted_frame("close", w) for w in windows} | {"_first": first})
    at = lambda w, q: over_floor(F.coalesce(quantile_of(f"_s{w}", q, w // 2), F.col("_first")), "close")
    bars = bars.withColumns({f"QTLU_{w}": at(w, 0.8) for w in windows} | {f"QTLD_{w}": at(w, 0.2) for w in windows})
    return bars.drop("_first", *(f"_s{w}" for w in windows))


def rank(bars: DataFrame, windows=WINDOWS) -> DataFrame:
    """Share of the window that is not above the current close."""
    out = {}
    for w in windows:
        values, n = F.collect_list("close").over(frame(w)), F.count("close").over(frame(w))
        share = F.size(F.filter(values, lambda x: x <= F.col("close"))) / n.cast("double")
        out[f"RANK_{w}"] = F.when(n >= max(2, w // 2), share).otherwise(0.5)
    return bars.withColumns(out)


def rsv(bars: DataFrame, windows=WINDOWS) -> DataFrame:
    low, high = lambda w: rolling(F.min, "low", w), lambda w: rolling(F.max, "high", w)
    return bars.withColumns({f"RSV_{w}": _zero(over_shifted(F.col("close") - low(w), high(w) - low(w))) for w in windows})


def aroon(bars: DataFrame, windows=WINDOWS) -> DataFrame:
    """Where in the window the first highest high and lowest low stand."""
    out = {}
    for w in windows:
        f = frame(w)
        enough = F.count("high").over(f) >= w // 2
        for name, x, agg in (("IMAX", "high", F.max), ("IMIN", "low", F.min)):
            place = F.array_position(F.collect_list(x).over(f), agg(x).over(f)) - 1
            out[f"{name}_{w}"] = F.when(enough, place / float(w)).otherwise(0.0)
    bars = bars.withColumns(out)
    return bars.withColumns({f"IMXD_{w}": F.col(f"IMAX_{w}") - F.col(f"IMIN_{w}") for w in windows})


def corr(bars: DataFrame, windows=WINDOWS) -> DataFrame:
    bars = rolled(bars.withColumn("_lv", F.ln(F.col("volume") + 1)), ["close", "_lv"], windows, ["CORR"], correlation)
    return bars.withColumns({f"CORR_{w}": _zero(F.col(f"CORR_{w}")) for w in windows}).drop("_lv")


def cord(bars: DataFrame, windows=WINDOWS) -> DataFrame:
    bars = bars.withColumns({"_cr": over_floor("close", _prior_close()), "_vr": F.ln(F.greatest(over_floor("volume", shifted("volume")), F.lit(EPS)))})
    bars = bars.withColumn("_vr", F.when(F.col("_cr").isNotNull(), F.col("_vr")))
    bars = rolled(bars, ["_cr", "_vr"], windows, ["CORD"], correlation)
    return bars.withColumns({f"CORD_{w}": _zero(F.col(f"CORD_{w}")) for w in windows}).drop("_cr", "_vr")


def counts(bars: DataFrame, windows=WINDOWS) -> DataFrame:
    before = _prior_close()
    bars = bars.withColumns({"_up": F.when(F.col("close") > before, 1.0).otherwise(0.0), "_down": F.when(F.col("close") < before, 1.0).otherwise(0.0)})
    out = {f"CNTP_{w}": F.avg("_up").over(frame(w)) for w in windows} | {f"CNTN_{w}": F.avg("_down").over(frame(w)) for w in windows}
    bars = bars.withColumns(out)
    return bars.withColumns({f"CNTD_{w}": F.col(f"CNTP_{w}") - F.col(f"CNTN_{w}") for w in windows}).drop("_up", "_down")


def _moves(bars: DataFrame, x: str, prefix: str, windows) -> DataFrame:
    """Shares of rises and falls in all movement of x."""
    bars = bars.withColumn("_move", _zero(F.col(x) - shifted(x)))
    out = {}
    for w in windows:
        f = frame(w)
        enough = F.count("_move").over(f) >= w // 2
        total = F.sum(F.abs("_move")).over(f)
        rise, fall = F.sum(F.greatest("_move", F.lit(0.0))).over(f), F.sum(F.greatest(-F.col("_move"), F.lit(0.0))).over(f)
        out[f"{prefix}P_{w}"] = F.when(enough, over_shifted(rise, total)).otherwise(0.0)
        out[f"{prefix}N_{w}"] = F.when(enough, over_shifted(fall, total)).otherwise(0.0)
    bars = bars.withColumns(out)
    return bars.withColumns({f"{prefix}D_{w}": F.col(f"{prefix}P_{w}") - F.col(f"{prefix}N_{w}") for w in windows}).drop("_move")


def price_sums(bars: DataFrame, windows=WINDOWS) -> DataFrame:
    return _moves(bars, "close", "SUM", windows)


def volume_sums(bars: DataFrame, windows=WINDOWS) -> DataFrame:
    return _moves(bars, "volume", "VSUM", windows)


def volume_levels(bars: DataFrame, windows=WINDOWS) -> DataFrame:
    """Volume against its mean, and its spread; 0 for short windows."""
    mean, spread = lambda w: rolling(F.avg, "volume", w), lambda w: rolling(F.stddev_pop, "volume", w)
    return bars.withColumns(
        {f"VMA_{w}": _zero(over_shifted("volume", mean(w))) for w in windows} | {f"VSTD_{w}": _zero(over_shifted(spread(w), mean(w))) for w in windows}
    )


def weighted_volatility(bars: DataFrame, windows=WINDOWS) -> DataFrame:
    before = _prior_close()
    bars = bars.withColumn("_wv", _zero(F.abs(over_floor("close", before) - 1) * F.col("volume")))
    out = {f"WVMA_{w}": _zero(over_shifted(rolling(F.stddev_pop, "_wv", w), rolling(F.avg, "_wv", w))) for w in windows}
    return bars.withColumns(out).drop("_wv")


def label(bars: DataFrame) -> DataFrame:
    """The next bar's return; null for the last."""
    return bars.withColumn("label", over_floor(shifted("close", -1), "close") - 1)


def pct_change(bars: DataFrame) -> DataFrame:
    """pct_chg as a fraction; null for the first bar."""
    return bars.withColumn("pct_chg", over_floor("close", _prior_close()) - 1)


#: The families by name; the panel has all of them.
FAMILIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ma": ma,
    "roc": roc,
    "volatility": volatility,
    "bollinger": bollinger,
    "macd": macd,
    "rsi": rsi,
    "cci": cci,
    "atr": atr,
    "price_pos": price_position,
    "volume": volume,
    "amount": amount,
    "momentum": momentum,
    "kbar": kbar,
    "beta": lambda b: regression(b, kinds=("BETA",)),
    "rsqr": lambda b: regression(b, kinds=("RSQR",)),
    "resi": lambda b: regression(b, kinds=("RESI",)),
    "quantile": quantile,
    "rank": rank,
    "rsv": rsv,
    "aroon": aroon,
    "corr": corr,
    "cord": cord,
    "cnt": counts,
    "sum": price_sums,
    "vma": volume_levels,
    "wvma": weighted_volatility,
    "vsum": volume_sums,
}
KEYS = ("market", "symbol", "date")
#: What the families that go through Arrow read; Spark itself leaves out what others do not.
READ = {"beta": ("close",), "rsqr": ("close",), "resi": ("close",), "corr": ("close", "volume"), "cord": ("close", "volume")}


def family(bars: DataFrame, name: str) -> DataFrame:
    """The keys and one family's columns."""
    read = bars.select(*KEYS, *READ[name]) if name in READ else bars
    out = FAMILIES[name](dealt(read, "symbol"))
    return out.select(*KEYS, *(c for c in out.columns if c not in bars.columns))


def panel(bars: DataFrame, names: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """Bars with all families' columns; one exchange by symbol serves them all."""
    for name in names:
        bars = FAMILIES[name](bars)
    return bars
