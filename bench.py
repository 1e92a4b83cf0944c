"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from barspark.plans import registry
from barspark.session import RECOMMENDED

HEADLINE = [
    "agg9_sql_metrics",        # all ticker metrics in one grouping
    "sc13_rank_tickers",       # weighted ranking of every ticker
    "sc11_scoring_index",      # the stored index
    "ind13_technical_features",  # 23 indicator columns in one plan
    "lb1_macd_events",         # events with forward labels, two timeframes
    "lb6_minute_features",
    "fe2_daily_ic", "fe4_quantile_returns",
    "rk8_return_report", "fm2_capm", "win12_rolling_beta",
    "sg6_run_macd", "sg7_walk_forward",
]


def loop_seconds(folder: str) -> dict[str, float]:
    """The same figures from the same file by a single-process loop over tickers, for the ratio only."""
    def build() -> pd.DataFrame:
        line = pd.read_parquet(f"{folder}/lineitem.parquet")
        line["px"] = np.floor(line["l_extendedprice"] / line["l_quantity"] * 10) / 10000
        line["ticker"], line["date"] = "S" + line["l_suppkey"].astype(str), line["l_shipdate"].dt.date
        line["high"], line["low"] = line["px"] * (1 + line["l_tax"]), line["px"] * (1 - line["l_discount"])
        by = line.sort_values(["l_orderkey", "l_linenumber", "px"]).groupby(["ticker", "date"])
        return by.agg(open=("px", "first"), high=("high", "max"), low=("low", "min"), close=("px", "last"),
                      volume=("l_quantity", "sum")).reset_index()

    def indicators(g: pd.DataFrame) -> None:
        """Plain means and returns of each ticker on arrays: less work than the query does, so the ratio is a lower bound."""
        close = g["close"].to_numpy()
        change = np.diff(close) / close[:-1]
        sums = np.concatenate(([0.0], np.cumsum(close)))
        for n in (14, 20, 50, 200):
            if len(close) >= n:
                mean = (sums[n:] - sums[:-n]) / n
                spread = np.lib.stride_tricks.sliding_window_view(close, n).std(axis=1, ddof=1)
                np.stack([mean, mean + 2 * spread, mean - 2 * spread])
        np.cumsum(np.sign(change) * g["volume"].to_numpy()[1:])

    def metrics(g: pd.DataFrame) -> dict:
        r, width = g["close"].pct_change(), g["high"] - g["low"]
        return {"vol": r.std(), "swing": r.abs().mean(), "volume": g["volume"].mean(), "range": width.mean(), "median": width.median(),
                "sd": width.std(), "sweet": width.between(0.2, 0.6).sum(), "min": g["close"].min(), "max": g["close"].max(),
                "slope": np.polyfit(np.arange(len(g)), g["close"], 1)[0]}

    seconds = {}
    for name, work in (("ind13_technical_features", indicators), ("agg9_sql_metrics", metrics)):
        start = time.perf_counter()
        for _, rows in build().groupby("ticker"):
            work(rows.sort_values("date"))
        seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
               .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", cpus))
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    plans = registry.queries()
    plans[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()  # start-up, not measured
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        plans[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    loops = loop_seconds(folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "per_ticker_loop": loops,
                      "speedup_over_loop": {n: round(t / seconds[n], 2) for n, t in loops.items()}, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
