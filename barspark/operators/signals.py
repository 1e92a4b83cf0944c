"""Entry and exit signals, the positions, trades and equity they lead to, and their evaluation.

Fill rule: long only, all-in, at the close of the signal bar; buys cost ``slippage``
more, sells bring ``slippage`` less, and each side pays ``fee`` on its value.  An entry
while invested and an exit while flat do nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.ewm import ewm, ewm_short, width
from ..functions.frames import DAILY, Series, positioned, previous
from ..functions.numeric import ratio
from . import indicators, risk
from .macd import crossings, macd

FEE = 0.001
SLIPPAGE = 0.001


def macd_signals(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, series: Series = DAILY) -> DataFrame:
    df = crossings(macd(df, series, fast, slow, signal), series)
    return df.withColumns({"entry": F.col("cross_up") == 1, "exit": F.col("cross_down") == 1})


def rsi_signals(df: DataFrame, period: int = 14, oversold: float = 30.0, overbought: float = 70.0,
                series: Series = DAILY) -> DataFrame:
    """Enter when the index falls below ``oversold``, leave when it rises above ``overbought``."""
    df = indicators.rsi(df, period, series).withColumnRenamed(f"rsi_{period}", "rsi")
    df = df.withColumn("_before", previous("rsi", series))
    return df.withColumns({
        "entry": F.coalesce((F.col("rsi") < oversold) & (F.col("_before") >= oversold), F.lit(False)),
        "exit": F.coalesce((F.col("rsi") > overbought) & (F.col("_before") <= overbought), F.lit(False)),
    }).drop("_before")


def custom_signals(df: DataFrame, entry: Column, exit: Column) -> DataFrame:
    return df.withColumns({"entry": F.coalesce(entry, F.lit(False)), "exit": F.coalesce(exit, F.lit(False))})


def mean_reversion(df: DataFrame) -> DataFrame:
    """Oversold below the lower band without a trend; leave above the mean.  Needs technical features."""
    return custom_signals(df, (F.col("rsi_14") < 30) & (F.col("bb_pct") < 0) & (F.col("adx_14") < 20),
                          F.col("close") > F.col("bb_middle"))


def momentum(df: DataFrame) -> DataFrame:
    """Strong but not overbought, fast mean above slow, rising; leave when the means cross back."""
    return custom_signals(df, F.col("rsi_14").between(50, 70) & (F.col("sma_cross_20_50") > 0)
                          & (F.col("adx_14") > 25) & (F.col("roc_10") > 0), F.col("sma_cross_20_50") < 0)


def simulate(df: DataFrame, fee: float = FEE, slippage: float = SLIPPAGE, series: Series = DAILY) -> DataFrame:
    """Add position, trade number, the bar's return on the account (``ret``) and equity from 1."""
    said = F.when(F.col("entry"), 1).when(F.col("exit"), 0)
    df = df.withColumn("_said", said)
    df = df.withColumn("position", F.coalesce(F.last("_said", ignorenulls=True).over(series.running()), F.lit(0)))
    df = df.withColumns({"_held": F.coalesce(previous("position", series), F.lit(0)),
                         "_pc": previous("close", series)})
    df = df.withColumns({"opens": (F.col("position") == 1) & (F.col("_held") == 0),
                         "closes": (F.col("position") == 0) & (F.col("_held") == 1)})
    growth = (F.when(F.col("_held") == 1, F.coalesce(ratio(F.col("close"), F.col("_pc")), F.lit(1.0))).otherwise(1.0)
              * F.when(F.col("opens"), (1.0 - fee) / (1.0 + slippage)).otherwise(1.0)
              * F.when(F.col("closes"), (1.0 - fee) * (1.0 - slippage)).otherwise(1.0))
    df = df.withColumn("ret", growth - 1.0)
    return df.withColumns({
        "trade": F.sum(F.col("opens").cast("int")).over(series.running()),
        "equity": F.product(F.lit(1.0) + F.col("ret")).over(series.running()),
    }).drop("_said", "_held", "_pc")


def trades(simulated: DataFrame, series: Series = DAILY) -> DataFrame:
    """One row per trade; an open one is valued at the last close."""
    inside = simulated.filter((F.col("position") == 1) | F.col("closes"))
    return inside.groupBy(*series.keys, "trade").agg(
        F.min(series.order).alias("entry_date"),
        F.max(F.when(F.col("closes"), F.col(series.order))).alias("exit_date"),
        (F.product(F.lit(1.0) + F.col("ret")) - 1.0).alias("trade_return"),
        F.count_if(F.col("position") == 1).alias("bars"))


def strategy_stats(simulated: DataFrame, series: Series = DAILY) -> DataFrame:
    """Account and trade figures per series.  ``avg_winning_trade`` is the mean over winners only."""
    account = risk.report(simulated.select(*series.keys, series.order, "ret"), series=series).select(
        *series.keys, "total_return", "sharpe_ratio", "sortino_ratio", "max_drawdown")
    r = F.col("trade_return")
    deals = trades(simulated, series).groupBy(*series.keys).agg(
        F.count(F.lit(1)).alias("total_trades"), risk.win_rate("trade_return").alias("win_rate"),
        risk.profit_factor("trade_return").alias("profit_factor"),
        F.avg(F.when(r > 0, r)).alias("avg_winning_trade"), F.max(r).alias("best_trade"), F.min(r).alias("worst_trade"))
    return account.join(deals, list(series.keys), "left").withColumn(
        "total_trades", F.coalesce("total_trades", F.lit(0)))


STRATEGIES: dict[str, tuple[Callable[[DataFrame], DataFrame], int]] = {
    # name -> (signals, rows a ticker needs)
    "macd": (macd_signals, 26 + 9),
    "rsi": (rsi_signals, 14 + 10),
}


def run_strategy(daily: DataFrame, name: str, fee: float = FEE, slippage: float = SLIPPAGE) -> DataFrame:
    """Stats of a named strategy for every ticker with enough rows."""
    if name not in STRATEGIES:
        raise ValueError(f"strategy {name}; one of {sorted(STRATEGIES)}")
    make, rows = STRATEGIES[name]
    enough = daily.withColumn("_rows", F.count(F.lit(1)).over(DAILY.whole())).filter(F.col("_rows") >= rows)
    return strategy_stats(simulate(make(enough.drop("_rows")), fee, slippage))


# --- walk-forward -------------------------------------------------------------------

_SLICE = ("window", "phase")
_NUMBERED = "{}_{}".format


@dataclass(frozen=True)
class Strategy:
    """A strategy whose parameters can be searched.

    ``signals(df, series, sets)`` adds ``entry_<i>`` and ``exit_<i>`` for every set of parameters; what several sets have in common is
    computed once.
    """

    parameters: tuple[str, ...]
    signals: Callable[[DataFrame, Series, Sequence[dict]], DataFrame]


def _smoothed(df: DataFrame, means: dict[str, tuple[Column, float]], series: Series) -> DataFrame:
    """One running sum for spans of which a block covers the series, block sums for the others (short spans in long slices)."""
    short = {n: m for n, m in means.items() if m[1] <= 1 or width(m[1]) >= series.max_rows}
    df = ewm_short(df, short, series) if short else df
    rest = {n: m for n, m in means.items() if n not in short}
    return ewm(df, rest, series) if rest else df


def _macd_sets(df: DataFrame, series: Series, sets: Sequence[dict]) -> DataFrame:
    """The grid as a prefix tree: spans of the close, lines of two spans, signals of a line; each is smoothed once."""
    had = df.columns
    spans = sorted({v for s in sets for v in (s["fast"], s["slow"])})
    lines = sorted({(s["fast"], s["slow"]) for s in sets})
    leaves = sorted({(s["fast"], s["slow"], s["signal"]) for s in sets})
    df = _smoothed(df, {f"_e{spans.index(v)}": (F.col("close"), v) for v in spans}, series)
    df = df.withColumns({f"_l{i}": F.col(f"_e{spans.index(f)}") - F.col(f"_e{spans.index(w)}") for i, (f, w) in enumerate(lines)})
    df = _smoothed(df, {f"_g{i}": (F.col(f"_l{lines.index((f, w))}"), g) for i, (f, w, g) in enumerate(leaves)}, series)
    df = df.withColumns({f"_h{i}": F.col(f"_l{lines.index((f, w))}") - F.col(f"_g{i}") for i, (f, w, _) in enumerate(leaves)})
    df = df.withColumns({f"_b{i}": previous(f"_h{i}", series) for i in range(len(leaves))})
    out = {}
    for n, s in enumerate(sets):
        i = leaves.index((s["fast"], s["slow"], s["signal"]))
        out[_NUMBERED("entry", n)] = F.coalesce((F.col(f"_b{i}") <= 0) & (F.col(f"_h{i}") > 0), F.lit(False))
        out[_NUMBERED("exit", n)] = F.coalesce((F.col(f"_b{i}") >= 0) & (F.col(f"_h{i}") < 0), F.lit(False))
    return df.withColumns(out).select(*had, *out)


def _rsi_sets(df: DataFrame, series: Series, sets: Sequence[dict]) -> DataFrame:
    """Each period's index once, thresholds on it; a short series keeps one order of rows throughout."""
    had, periods = df.columns, sorted({s["period"] for s in sets})
    df = positioned(df, series)
    for p in periods:
        df = indicators.rsi(df, p, series, _smoothed).withColumnRenamed(f"rsi_{p}", f"_rsi{p}")
    df = df.withColumns({f"_was{p}": previous(f"_rsi{p}", series) for p in periods})
    out = {}
    for n, s in enumerate(sets):
        now, was = F.col(f"_rsi{s['period']}"), F.col(f"_was{s['period']}")
        out[_NUMBERED("entry", n)] = F.coalesce((now < s["oversold"]) & (was >= s["oversold"]), F.lit(False))
        out[_NUMBERED("exit", n)] = F.coalesce((now > s["overbought"]) & (was <= s["overbought"]), F.lit(False))
    return df.withColumns(out).select(*had, *out)


def searched(make: Callable[..., DataFrame], parameters: Sequence[str]) -> Strategy:
    """Any function (df, series, **parameters) that adds ``entry`` and ``exit``."""
    def sets_of(df: DataFrame, series: Series, sets: Sequence[dict]) -> DataFrame:
        for n, s in enumerate(sets):
            kept = df.columns
            df = make(df, series, **s).select(*kept, F.col("entry").alias(_NUMBERED("entry", n)), F.col("exit").alias(_NUMBERED("exit", n)))
        return df

    return Strategy(tuple(parameters), sets_of)


SEARCHES = {"macd": Strategy(("fast", "slow", "signal"), _macd_sets), "rsi": Strategy(("period", "oversold", "overbought"), _rsi_sets)}


def parameter_grid(**values: Sequence[float]) -> list[dict]:
    """All combinations of some values of each parameter, the last one changing fastest."""
    return [dict(zip(values, combination)) for combination in product(*values.values())]


def macd_grid(fast: Sequence[int], slow: Sequence[int], signal: Sequence[int]) -> list[dict]:
    return parameter_grid(fast=fast, slow=slow, signal=signal)


def windows(daily: DataFrame, train_months: int = 6, test_months: int = 1) -> DataFrame:
    """Every bar once per training and test window it belongs to (bounds inclusive at both ends).

    A bar lies in a fixed number of windows, found by date arithmetic, so this is an
    explode of about (train + test) / test rows and not a join.
    """
    w = DAILY.whole()
    df = daily.withColumns({"_first": F.min("date").over(w), "_last": F.max("date").over(w)})
    month = F.floor(F.months_between("date", "_first") / test_months).cast("int")
    reach = -(-(train_months + test_months) // test_months) + 1
    df = df.withColumn("window", F.explode(F.sequence(F.greatest(F.lit(0), month - reach), month + 1)))
    start = F.add_months("_first", F.col("window") * test_months)
    df = df.withColumns({"_start": start, "_split": F.add_months(start, train_months),
                         "_end": F.add_months(start, train_months + test_months)})
    df = df.filter((F.col("_end") <= F.col("_last")) & F.col("date").between(F.col("_start"), F.col("_end")))
    phases = F.array_compact(F.array(F.when(F.col("date") <= F.col("_split"), F.lit("train")),
                                     F.when(F.col("date") >= F.col("_split"), F.lit("test"))))
    return df.withColumn("phase", F.explode(phases)).drop("_first", "_last", "_start", "_split", "_end")


#: Figures that can decide, as aggregates over a slice: the returns of the account, its drawdown, or the results of trades.
_ACCOUNT: dict[str, Callable[[str], Column]] = {
    "total_return": lambda r: F.product(F.lit(1.0) + F.col(r)) - 1.0,
    "sharpe_ratio": lambda r: risk.sharpe(r), "sortino_ratio": lambda r: risk.sortino(r)}
_TRADES: dict[str, Callable[[str], Column]] = {
    "total_trades": lambda t: F.count(t).cast("double"), "win_rate": risk.win_rate,
    "profit_factor": lambda t: F.when(F.count(t) > 0, F.coalesce(risk.profit_factor(t), F.lit(float("inf")))),  # no losses: unbounded
    "avg_winning_trade": lambda t: F.avg(F.when(F.col(t) > 0, F.col(t))), "best_trade": lambda t: F.max(t), "worst_trade": lambda t: F.min(t)}
METRICS = (*_ACCOUNT, "max_drawdown", *_TRADES)


def _accounts(df: DataFrame, n: int, metric: str, fee: float, slippage: float, series: Series) -> DataFrame:
    """``simulate`` for all sets side by side: ``_ret_<i>``, and what the metric needs besides."""
    cols = range(n)
    df = df.withColumns({f"_pos_{i}": F.coalesce(F.last(F.when(F.col(f"entry_{i}"), 1).when(F.col(f"exit_{i}"), 0), ignorenulls=True)
                                                 .over(series.running()), F.lit(0)) for i in cols})
    df = df.withColumns({"_pc": previous("close", series), **{f"_held_{i}": F.coalesce(previous(f"_pos_{i}", series), F.lit(0)) for i in cols}})

    def opens(i: int) -> Column:
        return (F.col(f"_pos_{i}") == 1) & (F.col(f"_held_{i}") == 0)

    def closes(i: int) -> Column:
        return (F.col(f"_pos_{i}") == 0) & (F.col(f"_held_{i}") == 1)

    move = F.coalesce(ratio(F.col("close"), F.col("_pc")), F.lit(1.0))
    df = df.withColumns({f"_ret_{i}": F.when(F.col(f"_held_{i}") == 1, move).otherwise(1.0)
                         * F.when(opens(i), (1.0 - fee) / (1.0 + slippage)).otherwise(1.0)
                         * F.when(closes(i), (1.0 - fee) * (1.0 - slippage)).otherwise(1.0) - 1.0 for i in cols})
    if metric in _ACCOUNT:
        return df
    df = df.withColumns({f"_wealth_{i}": F.product(F.lit(1.0) + F.col(f"_ret_{i}")).over(series.running()) for i in cols})
    if metric == "max_drawdown":
        return df.withColumns({f"_fall_{i}": F.col(f"_wealth_{i}") / F.max(f"_wealth_{i}").over(series.running()) - 1.0 for i in cols})
    start = {f"_start_{i}": F.last(F.when(opens(i), F.col(f"_wealth_{i}") / (F.lit(1.0) + F.col(f"_ret_{i}"))), ignorenulls=True).over(series.running()) for i in cols}
    df = df.withColumns({**start, "_last": F.col(series.order) == F.max(series.order).over(series.whole())})
    return df.withColumns({f"_trade_{i}": F.when(closes(i) | (F.col("_last") & (F.col(f"_pos_{i}") == 1)), F.col(f"_wealth_{i}") / F.col(f"_start_{i}") - 1.0) for i in cols})


def _figure(metric: str, i: int) -> Column:
    if metric in _ACCOUNT:
        return _ACCOUNT[metric](f"_ret_{i}")
    return F.min(f"_fall_{i}") if metric == "max_drawdown" else _TRADES[metric](f"_trade_{i}")


def walk_forward(daily: DataFrame, grid: Sequence[dict], train_months: int = 6, test_months: int = 1, metric: str = "sharpe_ratio",
                 fee: float = FEE, slippage: float = SLIPPAGE, strategy: str | Strategy = "macd") -> DataFrame:
    """Per ticker and window: the parameters with the highest ``metric`` in training (a column each), and their test result.

    ``grid`` has a dict for each set of parameters (``parameter_grid``), ``strategy`` is a name of ``SEARCHES`` or a ``Strategy``
    (``searched`` makes one of any function), ``metric`` one of ``METRICS``. Smoothing and positions restart in each slice. All sets are
    columns of the same rows, so each bar stands once in a slice and one exchange and sort serve every set.  Among equals (to nine digits) the first
    set of the grid is taken; a set without a figure in training is not.
    """
    if metric not in METRICS:
        raise ValueError(f"metric {metric}; one of {METRICS}")
    if isinstance(strategy, str):
        if strategy not in SEARCHES:
            raise ValueError(f"strategy {strategy}; one of {sorted(SEARCHES)}")
        strategy = SEARCHES[strategy]
    if not grid:
        raise ValueError("no set of parameters")
    if wrong := [s for s in grid if set(s) != set(strategy.parameters)]:
        raise ValueError(f"{wrong[0]}: the parameters are {strategy.parameters}")
    # one bar a day, bounds inclusive
    series = DAILY.with_keys(*_SLICE, max_rows=31 * max(train_months, test_months) + 1)
    df = strategy.signals(windows(daily, train_months, test_months), series, grid)
    df = _accounts(df, len(grid), metric, fee, slippage, series)
    sets = F.array(*[F.struct(F.round(_figure(metric, i), 9).alias("by"), F.lit(-i).alias("set"), _figure(metric, i).alias("train"),
                              _ACCOUNT["total_return"](f"_ret_{i}").alias("total_return"), risk.sharpe(f"_ret_{i}").alias("sharpe_ratio"))
                     for i in range(len(grid))])
    slices = df.groupBy(*series.keys).agg(sets.alias("sets"))
    both = slices.groupBy("ticker", "window").agg(*[F.first(F.when(F.col("phase") == p, F.col("sets")), ignorenulls=True).alias(p) for p in ("train", "test")])
    both = both.withColumn("best", F.array_max(F.filter("train", lambda x: x["by"].isNotNull())))
    both = both.withColumn("tested", F.get(F.filter("test", lambda x: x["set"] == F.col("best.set")), F.lit(0)))
    names = {p: F.element_at(F.array(*[F.lit(float(s[p])) if isinstance(s[p], (int, float)) else F.lit(s[p]) for s in grid]), 1 - F.col("best.set")) for p in strategy.parameters}
    return (both.filter(F.col("best").isNotNull() & F.col("tested").isNotNull())
            .select("ticker", "window", *[c.alias(p) for p, c in names.items()], F.col("best.train").alias("train_metric"),
                    F.col("tested.total_return").alias("test_return"), F.col("tested.sharpe_ratio").alias("test_sharpe")))


def walk_forward_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("num_windows"), F.avg("test_return").alias("avg_test_return"),
        F.stddev_pop("test_return").alias("std_test_return"))


# --- sizing, regimes, resampling -------------------------------------------------------

def position_size(df: DataFrame, account: float = 100_000.0, risk_share: float = 0.01, max_account_share: float = 0.20,
                  max_volume_share: float = 0.05, atr_multiple: float = 2.0) -> DataFrame:
    """Stop at a multiple of the average true range, and whole shares by the tightest of three limits.

    Needs close, volume and atr_14.
    """
    entry = F.col("close")
    df = df.withColumn("stop_distance", F.col("atr_14") * atr_multiple)
    df = df.withColumns({
        "stop_price": entry - F.col("stop_distance"),
        "risk_shares": F.floor(ratio(F.lit(account * risk_share), F.col("stop_distance"))),
        "account_shares": F.floor(ratio(F.lit(account * max_account_share), entry)),
        "volume_shares": F.floor(F.col("volume") * max_volume_share)})
    df = df.withColumn("shares", F.least("risk_shares", "account_shares", "volume_shares"))
    return df.withColumns({"position_value": F.col("shares") * entry,
                           "risk_amount": F.col("shares") * F.col("stop_distance")})


def by_regime(returns: DataFrame, regimes: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Risk report per ticker and named date range (inclusive; ranges may overlap)."""
    day = F.col("date")
    names = F.array_compact(F.array(*[
        F.when(day.between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(n)) for n, a, b in regimes]))
    df = returns.withColumn("regime", F.explode(names))
    return risk.report(df, series=DAILY.with_keys("regime"))


# Multipliers and shifts of a published 32-bit integer mixer, here on 31 bits.
_MIX = ((16, 569_420_461), (15, 1_935_289_751))
_BITS = 31
_BELOW = (1 << _BITS) - 1
#: Slots drawn at a time, for all simulations of a ticker.
_SLOTS = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Pseudo-random numbers below 2**31 from numbers below 2**31, by arithmetic that any SQL engine has."""
    for shift, factor in _MIX:
        x = ((x ^ (x >> shift)) * factor) & _BELOW
    return x


def _compounded(growth: np.ndarray, own: int, simulations: int, seed: int) -> np.ndarray:
    """The result of each simulation: as many drawn growth factors as there are, multiplied slot by slot."""
    n = len(growth)
    starts = _mixed((own + seed + np.arange(1, simulations + 1, dtype=np.int64) * 1_000_003) & _BELOW)
    result = np.ones(simulations)
    for first in range(1, n + 1, _SLOTS):
        slots = np.arange(first, min(first + _SLOTS, n + 1), dtype=np.int64)[:, None]
        drawn = growth[(_mixed((starts + slots) & _BELOW) * n) >> _BITS]
        drawn[0] *= result
        result = np.multiply.reduce(drawn, axis=0)
    return result - 1.0


def _percentile(ordered: np.ndarray, share: float) -> float:
    """Interpolated as ``F.percentile`` does."""
    at = (len(ordered) - 1) * share
    low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
    return float(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)


def _spread(simulations: int, seed: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, growth in zip(batch.column("_own").to_pylist(), batch.column("_growth")):
                if own is None:  # nothing can be drawn for a ticker without a name
                    rows.append((None, None, None, 0.0))
                    continue
                with np.errstate(all="ignore"):
                    ends = np.sort(_compounded(growth.values.to_numpy(zero_copy_only=False), own, simulations, seed))  # NaN last
                    rows.append((*[_percentile(ends, q) for q in (0.5, 0.05, 0.95)], float(np.mean((ends > 0) | np.isnan(ends)))))
            figures = [pa.array([r[i] for r in rows], pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("ticker"), pa.array([simulations] * len(rows), pa.int64()), *figures], schema=schema)

    return spread


def bootstrap(all_trades: DataFrame, simulations: int = 1_000, seed: int = 42) -> DataFrame:
    """Resample each ticker's trades with replacement; spread of the compounded result.

    A ticker's trades, no more than it has days, become one array on the partition they are
    on; each simulation multiplies as many drawn growth factors as there are trades, a block of
    slots of all simulations at a time.  No draw is a row, so nothing but the trades is shuffled and nothing is joined.
    A draw depends on ticker, simulation, slot and seed alone.
    """
    growth = F.transform(F.array_sort(F.collect_list(F.struct("trade", (F.lit(1.0) + F.col("trade_return")).alias("growth")))),
                         lambda t: t["growth"])
    name = F.conv(F.substring(F.md5("ticker"), 1, 7), 16, 10).cast("long")
    per_ticker = all_trades.filter(F.col("trade_return").isNotNull()).groupBy("ticker").agg(growth.alias("_growth"))
    figures = ("median_return", "return_5pct", "return_95pct", "prob_positive")
    out = T.StructType([all_trades.schema["ticker"], T.StructField("simulations", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in figures]])
    return per_ticker.select("ticker", name.alias("_own"), "_growth").mapInArrow(_spread(simulations, seed, to_arrow_schema(out)), out)
