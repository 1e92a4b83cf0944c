"""Technical indicators per ticker, ordered by date."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from ..functions.ewm import ewm
from ..functions.frames import DAILY, POSITION, WIDE, Series, extremes, full, positioned, previous
from ..functions.numeric import TRADING_DAYS, ratio

INDICATORS = ["rsi_14", "stoch_k", "stoch_d", "roc_10", "adx_14", "bb_upper", "bb_middle", "bb_lower", "bb_pct",
              "sma_cross_20_50", "sma_cross_50_200", "sma_20", "sma_50", "sma_200", "obv", "vwap", "atr_14",
              "hist_vol_20"]
FLAGS = ["rsi_overbought", "rsi_oversold", "above_bb_upper", "below_bb_lower", "strong_trend"]


def _with_moves(df: DataFrame, series: Series) -> DataFrame:
    """Per-row inputs of the smoothed indicators; on a first row moves are 0 and the range is high - low."""
    df = df.withColumns({"_pc": previous("close", series), "_ph": previous("high", series),
                         "_pl": previous("low", series)})
    step = F.coalesce(F.col("close") - F.col("_pc"), F.lit(0.0))
    up, down = F.col("high") - F.col("_ph"), F.col("_pl") - F.col("low")
    zero = F.lit(0.0)
    return df.withColumns({
        "_gain": F.greatest(step, zero), "_loss": F.greatest(-step, zero),
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")),
                          F.abs(F.col("low") - F.col("_pc"))),
        "_pdm": F.when((up > down) & (up > 0), up).otherwise(zero),
        "_mdm": F.when((down > up) & (down > 0), down).otherwise(zero),
        "_step": step,
    })


def _rsi(gain: Column, loss: Column) -> Column:
    """Strength 0 without losses, so the index is then 0, not 100."""
    strength = F.coalesce(ratio(gain, loss), F.lit(0.0))
    return F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + strength)


def _with_smoothed(df: DataFrame, series: Series, period: int) -> DataFrame:
    df = ewm(df, {f"_e{c}": (F.col(c), period) for c in ("_gain", "_loss", "_tr", "_pdm", "_mdm")}, series)
    plus, minus = (F.lit(100.0) * ratio(F.col(c), F.col("_e_tr")) for c in ("_e_pdm", "_e_mdm"))
    df = df.withColumns({"_plus": plus, "_minus": minus})
    dx = F.coalesce(F.lit(100.0) * ratio(F.abs(F.col("_plus") - F.col("_minus")), F.col("_plus") + F.col("_minus")),
                    F.lit(0.0))
    df = ewm(df, {f"adx_{period}": (dx, period)}, series)
    return df.withColumns({f"rsi_{period}": _rsi(F.col("_e_gain"), F.col("_e_loss")),
                           f"atr_{period}": F.col("_e_tr")})


def rsi(df: DataFrame, period: int = 14, series: Series = DAILY, smooth: Callable[..., DataFrame] = ewm) -> DataFrame:
    """``smooth`` adds the exponential means, as ``ewm`` does."""
    step = F.coalesce(F.col("close") - previous("close", series), F.lit(0.0))
    df = df.withColumn("_step", step)
    zero = F.lit(0.0)
    df = smooth(df, {"_g": (F.greatest(F.col("_step"), zero), period),
                     "_l": (F.greatest(-F.col("_step"), zero), period)}, series)
    return df.withColumn(f"rsi_{period}", _rsi(F.col("_g"), F.col("_l"))).drop("_step", "_g", "_l")


def adx(df: DataFrame, period: int = 14, series: Series = DAILY) -> DataFrame:
    """Trend strength and average true range."""
    keep = [*df.columns, f"adx_{period}", f"atr_{period}"]
    return _with_smoothed(_with_moves(positioned(df, series), series), series, period).select(*keep)


#: Parts of a wide mean.
_PARTS = 4


def _mean(column: str, n: int, series: Series) -> Column:
    return full(F.avg(column).over(series.last(n)), n)


def stochastic(df: DataFrame, k: int = 14, d: int = 3, series: Series = DAILY) -> DataFrame:
    df = positioned(df, series)
    df = extremes(df, {"_lo": ("low", "min"), "_hi": ("high", "max")}, k, series)
    df = df.withColumn("stoch_k", full(ratio(F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 100.0, k))
    seen = F.count("stoch_k").over(series.last(d)) == d
    return df.withColumn("stoch_d", F.when(seen, F.avg("stoch_k").over(series.last(d)))).drop("_lo", "_hi")


def rate_of_change(df: DataFrame, n: int = 10, series: Series = DAILY) -> DataFrame:
    before = previous("close", series, n)
    return df.withColumn("_before", before).withColumn(
        f"roc_{n}", ratio(F.col("close") - F.col("_before"), F.col("_before")) * 100.0).drop("_before")


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0, population: bool = False,
              series: Series = DAILY) -> DataFrame:
    """Bands around the n-row mean; sample deviation, or population as charts draw them."""
    df = positioned(df, series)
    spread = (F.stddev_pop if population else F.stddev_samp)("close").over(series.last(n))
    df = df.withColumns({"bb_middle": _mean("close", n, series), "_sd": full(spread, n)})
    df = df.withColumns({"bb_upper": F.col("bb_middle") + F.lit(width) * F.col("_sd"),
                         "bb_lower": F.col("bb_middle") - F.lit(width) * F.col("_sd")})
    return df.withColumn("bb_pct", ratio(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")))\
        .drop("_sd")


def _with_means(df: DataFrame, column: str, lengths: tuple[int, ...], series: Series) -> DataFrame:
    """``sma_<n>``; a frame looks at all its rows for each row, so a wide one is put together from sums of a quarter of its rows."""
    wide = [n for n in lengths if n >= WIDE and n % _PARTS == 0 and df.schema[column].dataType == DoubleType()]
    df = df.withColumns({
        **{f"sma_{n}": _mean(column, n, series) for n in lengths if n not in wide},
        **{f"_{kind}_{n}": agg(column).over(series.last(n // _PARTS)) for n in wide for kind, agg in (("sum", F.sum), ("rows", F.count))}})
    if not wide:
        return df

    def whole(name: str, n: int) -> Column:
        return sum((F.coalesce(previous(name, series, i * n // _PARTS), F.lit(0)) for i in range(1, _PARTS)), F.coalesce(name, F.lit(0)))

    return (df.withColumns({f"_all_{kind}_{n}": whole(f"_{kind}_{n}", n) for n in wide for kind in ("sum", "rows")})
            .withColumns({f"sma_{n}": full(ratio(F.col(f"_all_sum_{n}"), F.col(f"_all_rows_{n}")), n) for n in wide})
            .drop(*[f"{a}_{kind}_{n}" for n in wide for kind in ("sum", "rows") for a in ("", "_all")]))


def moving_averages(df: DataFrame, lengths: tuple[int, ...] = (20, 50, 200), series: Series = DAILY) -> DataFrame:
    """Means over full windows, and the difference of each neighbouring pair."""
    df = _with_means(positioned(df, series), "close", lengths, series)
    return df.withColumns({f"sma_cross_{a}_{b}": F.col(f"sma_{a}") - F.col(f"sma_{b}")
                           for a, b in zip(lengths, lengths[1:])})


def on_balance_volume(df: DataFrame, series: Series = DAILY) -> DataFrame:
    step = F.coalesce(F.col("close") - previous("close", series), F.lit(0.0))
    return (df.withColumn("_signed", F.signum(step) * F.col("volume"))
            .withColumn("obv", F.sum("_signed").over(series.running())).drop("_signed"))


def vwap(df: DataFrame, series: Series = DAILY) -> DataFrame:
    """Volume-weighted typical price since the first row of the series."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    return df.withColumn("vwap", ratio(F.sum(typical * F.col("volume")).over(series.running()),
                                       F.sum("volume").over(series.running())))


def historical_volatility(df: DataFrame, n: int = 20, series: Series = DAILY) -> DataFrame:
    before = F.col("_pc") if "_pc" in df.columns else previous("close", series)
    df = df.withColumn("_lr", F.ln(ratio(F.col("close"), before)))
    whole = F.count("_lr").over(series.last(n)) == n
    return df.withColumn(f"hist_vol_{n}", F.when(
        whole, F.stddev_samp("_lr").over(series.last(n)) * math.sqrt(TRADING_DAYS))).drop("_lr")


def flags(df: DataFrame) -> DataFrame:
    """0/1 columns; a comparison with NULL counts as 0."""
    tests = {"rsi_overbought": F.col("rsi_14") > 70, "rsi_oversold": F.col("rsi_14") < 30,
             "above_bb_upper": F.col("close") > F.col("bb_upper"),
             "below_bb_lower": F.col("close") < F.col("bb_lower"), "strong_trend": F.col("adx_14") > 25}
    return df.withColumns({n: F.coalesce(t, F.lit(False)).cast("int") for n, t in tests.items()})


def technical_features(daily: DataFrame, series: Series = DAILY) -> DataFrame:
    """Every indicator in one plan: one exchange on the series keys for all of them."""
    keep = ["ticker", "date", "open", "high", "low", "close", "volume"]
    df = positioned(daily.select(*keep), series)
    # moves first: the volatility reads their previous close
    for step in (_with_moves, rate_of_change, bollinger, vwap, stochastic, historical_volatility, on_balance_volume,
                 moving_averages):
        df = step(df, series=series)
    df = flags(_with_smoothed(df, series, 14))
    return df.select(*keep, *INDICATORS, *FLAGS, F.year("date").alias("year"), F.month("date").alias("month"))


def chart_rsi(df: DataFrame, n: int = 14, series: Series = DAILY) -> DataFrame:
    """Plain n-row means of gains and losses; 100 without losses; NULL for the first n rows."""
    df = positioned(df, series)
    step = F.col("close") - previous("close", series)
    df = df.withColumns({"_g": F.greatest(step, F.lit(0.0)), "_l": F.greatest(-step, F.lit(0.0))})
    # F.greatest skips NULLs, so the first row counts as 0; it is never inside a full window.
    gain, loss = (F.avg(c).over(series.last(n)) for c in ("_g", "_l"))
    df = df.withColumns({"_ag": gain, "_al": loss})
    index = F.when(F.col("_al") == 0, F.lit(100.0)).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ratio(F.col("_ag"), F.col("_al"))))
    return df.withColumn("chart_rsi", F.when(F.col(POSITION) >= n, index)).drop("_g", "_l", "_ag", "_al")


CHART_PERIODS = {"1d": ("days", 1), "5d": ("days", 5), "30d": ("days", 30), "6mo": ("months", 6),
                 "12mo": ("months", 12)}


def chart_range(df: DataFrame, period: str, series: Series = DAILY) -> DataFrame:
    """Rows of the last period, counted back from each ticker's newest date."""
    unit, n = CHART_PERIODS[period]
    newest = F.max("date").over(series.whole())
    start = F.date_sub(newest, n) if unit == "days" else F.add_months(newest, -n)
    return df.withColumn("_start", start).filter(F.col("date") >= F.col("_start")).drop("_start")


def williams_r(df: DataFrame, n: int = 14, series: Series = DAILY) -> DataFrame:
    df = positioned(df, series)
    df = extremes(df, {"_hi": ("high", "max"), "_lo": ("low", "min")}, n, series)
    return df.withColumn(f"williams_r_{n}", full(
        F.lit(-100.0) * ratio(F.col("_hi") - F.col("close"), F.col("_hi") - F.col("_lo")), n)).drop("_hi", "_lo")


def volume_surge(df: DataFrame, n: int = 20, series: Series = DAILY) -> DataFrame:
    df = positioned(df, series)
    return df.withColumn("_usual", _mean("volume", n, series)).withColumn(
        "volume_surge", ratio(F.col("volume"), F.col("_usual"))).drop("_usual")
