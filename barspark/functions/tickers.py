"""Ticker text rules: which symbols are ordinary shares, and chart links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Characters that mark a special security, and the chart address.
SPECIAL_CHARACTERS = r"[.\-^+=/#@!$%&*]"
CHART_ADDRESS = "https://www.tradingview.com/chart/?symbol="


def is_tradable(ticker: Column) -> Column:
    """True for an ordinary share symbol; warrants, units, rights, preferreds and tests are not."""
    t = F.upper(F.trim(ticker))
    n = F.length(t)
    excluded = (
        (n < 1)
        | t.rlike(SPECIAL_CHARACTERS)
        | t.contains("TEST")
        | (n >= 7)
        | ((n >= 5) & t.rlike("(W|WS|WT|U)$"))
        | ((n == 5) & t.rlike(r"\p{L}R$"))
        | ((n >= 4) & (F.instr(t, "PR") >= 3))
        | ((n >= 4) & t.rlike(r"^\p{L}+P$"))
        | t.rlike("[0-9].")
    )
    return F.coalesce(~excluded, F.lit(False))


def tradable_only(df: DataFrame, column: str = "ticker") -> DataFrame:
    return df.filter(is_tradable(F.col(column)))


def chart_link(ticker: Column, interval: int, exchange: str | None = None) -> Column:
    prefix = f"{exchange}:" if exchange else ""
    return F.concat(F.lit(CHART_ADDRESS + prefix), ticker, F.lit(f"&interval={interval}"))


def with_chart_links(df: DataFrame, exchange: str | None = None, column: str = "ticker") -> DataFrame:
    return df.withColumns({f"tv_{i}m": chart_link(F.col(column), i, exchange) for i in (1, 5)})
