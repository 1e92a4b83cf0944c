"""Forward-looking labels and the event and model tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.frames import DAILY, INTRADAY, Series, extremes, following
from ..functions.numeric import change, ratio
from ..functions.tickers import tradable_only, with_chart_links
from .intraday import in_price_band
from .macd import crossings, macd


def forward_extremes(df: DataFrame, bars: int, series: Series = INTRADAY) -> DataFrame:
    """Highest high and lowest low of the next ``bars`` rows; NULL unless all of them exist."""
    return extremes(df, {f"fwd_max_high_{bars}": ("high", "max"), f"fwd_min_low_{bars}": ("low", "min")}, bars, series, ahead=True)


def label_moves(df: DataFrame, move: float, bars: int, entry: str = "close") -> DataFrame:
    """0/1 labels of reaching +move or -move within ``bars`` rows, and the extreme returns.

    Label columns are named by the move in basis points, e.g. ``label_up_80bp_30m``.
    """
    up = change(F.col(f"fwd_max_high_{bars}"), F.col(entry))
    down = change(F.col(f"fwd_min_low_{bars}"), F.col(entry))
    name = f"{round(move * 10_000)}bp_{bars}m"
    df = df.withColumns({f"fwd_up_ret_{bars}m": up, f"fwd_dn_ret_{bars}m": down})
    return df.withColumns({
        f"label_up_{name}": (F.col(f"fwd_up_ret_{bars}m") >= move).cast("int"),
        f"label_dn_{name}": (F.col(f"fwd_dn_ret_{bars}m") <= -move).cast("int"),
    })


def range_expansion(daily: DataFrame, threshold: float = 0.08, series: Series = DAILY) -> DataFrame:
    """Is tomorrow's high-low range at least ``threshold`` of today's close?  A series' last row is left out."""
    wide = following("high", series) - following("low", series)
    out = daily.withColumn("next_day_range_pct", ratio(wide, F.col("close")))
    return (out.filter(F.col("next_day_range_pct").isNotNull())
            .select("ticker", "date", "next_day_range_pct",
                    (F.col("next_day_range_pct") >= threshold).cast("int").alias("label_next_day_range_expand")))


def _events(bars: DataFrame, tf: str, move: float, ahead: int, up: bool, down: bool) -> DataFrame:
    df = crossings(macd(bars))
    df = label_moves(forward_extremes(df, ahead), move, ahead)  # labels first: they need every bar
    kind = F.when(F.lit(up) & (F.col("cross_up") == 1), "cross_up").when(
        F.lit(down) & (F.col("cross_down") == 1), "cross_down")
    name = f"{round(move * 10_000)}bp_{ahead}m"
    return df.withColumns({"event_type": kind, "tf": F.lit(tf)}).filter(F.col("event_type").isNotNull()).select(
        "ticker", "dt", "date", "tf", "event_type", "macd", "signal", "hist", "hist_prev",
        F.col("close").alias("entry_close"), f"label_up_{name}", f"label_dn_{name}",
        f"fwd_up_ret_{ahead}m", f"fwd_dn_ret_{ahead}m", f"fwd_max_high_{ahead}", f"fwd_min_low_{ahead}")


def macd_events(minute: DataFrame, five: DataFrame, move: float = 0.008, ahead: int = 30,
                up: bool = True, down: bool = True, exchange: str | None = None) -> DataFrame:
    """MACD histogram crossings on both timeframes with their forward labels and chart links."""
    both = _events(minute, "1m", move, ahead, up, down).unionByName(_events(five, "5m", move, ahead, up, down))
    return with_chart_links(both, exchange)


def event_features(events: DataFrame) -> DataFrame:
    return events.withColumns({
        "hist_momentum": F.col("hist") - F.col("hist_prev"),
        "hist_abs": F.abs("hist"), "macd_abs": F.abs("macd"), "signal_abs": F.abs("signal")})


def with_macd_day(events: DataFrame, macd_day: DataFrame) -> DataFrame:
    wide = macd_day.withColumns({
        f"hist_range__{tf}": F.col(f"hist_max__{tf}") - F.col(f"hist_min__{tf}") for tf in ("1m", "5m")})
    return events.join(wide, ["ticker", "date"], "left")


def with_volatility(events: DataFrame, features: DataFrame) -> DataFrame:
    return events.join(features, ["ticker", "date"], "left")


def event_dataset(events: DataFrame, macd_day: DataFrame, features: DataFrame,
                  daily: DataFrame | None = None, band: tuple[float, float] | None = None) -> DataFrame:
    """Events with event, MACD-day and volatility features, optionally only in-band ticker-days.

    The band is applied first: it is a semi join and leaves fewer rows for the others.
    """
    if daily is not None and band is not None:
        events = in_price_band(events, daily, *band)
    return with_volatility(with_macd_day(event_features(events), macd_day), features)


def next_day_dataset(features: DataFrame, columns: list[str], min_rows: int = 100,
                     target_column: str | None = None, series: Series = DAILY) -> DataFrame:
    """Feature rows with the next row's return (or next ``target_column``) as target.

    Tickers with fewer than ``min_rows`` rows are left out, then rows with a NULL.
    """
    target = (following(target_column, series) if target_column
              else change(following("close", series), F.col("close")))
    df = features.withColumns({"target": target, "_rows": F.count(F.lit(1)).over(series.whole())})
    return (df.filter(F.col("_rows") >= min_rows)
            .select("ticker", "date", *columns, "target")
            .na.drop(subset=[*columns, "target"]))


def low_price_tickers(daily: DataFrame, max_price: float = 10.0, min_avg_volume: float = 100_000) -> DataFrame:
    return (daily.groupBy("ticker")
            .agg(F.avg("close").alias("avg_close"), F.max_by("close", "date").alias("last_close"),
                 F.avg("volume").alias("avg_volume"), F.count(F.lit(1)).alias("day_count"))
            .filter((F.col("avg_close") <= max_price) & (F.col("avg_volume") >= min_avg_volume)))


def low_price_minutes(minute: DataFrame, daily: DataFrame, max_price: float = 10.0,
                      min_avg_volume: float = 100_000) -> DataFrame:
    """Minute bars of cheap, liquid, ordinary shares."""
    wanted = low_price_tickers(daily, max_price, min_avg_volume).select("ticker")
    return tradable_only(minute).join(wanted, "ticker", "left_semi")
